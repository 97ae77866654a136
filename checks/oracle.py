"""The checked queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from checks.inputs import CHUNKS, FEEDBACK, MODULES, RATING
from pagegauge import fixed_values as V
from pagegauge.functions.text import SPACE_CHARS, SPACE_CLASS

# RE2 has ASCII word boundaries and no look-around.
GAP = r"([^\n\r\x{2028}\x{2029}]*?)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return lit(pattern.replace("{b}", r"\b").replace("{s}", SPACE_CLASS).replace("{gap}", GAP))


def u16(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def trim(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def flat(x: str) -> str:
    return trim(f"regexp_replace({x}, '{SPACE_CLASS}+', ' ', 'g')")


def n_of(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({x}, {lit(p)}) THEN 1 ELSE 0 END)" for p in phrases) + ")"


def any_re(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {re2(p)})" for p in patterns) + ")"


def total(rules) -> str:
    terms = " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for _, w, c in rules)
    return f"(0::DOUBLE + {terms})"


def names(rules, extra: str = "") -> str:
    parts = ", ".join(f"CASE WHEN {c} THEN {lit(f)} END" for f, _, c in rules)
    return f"concat_ws(', ', {parts}{extra})"


BASE = f"""base AS (SELECT *, lower(text) AS l, lower(title) AS lt FROM ({CHUNKS}))"""

LINK_HOST = r"lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
RULES = {
    "biasDetector": [
        ("left_leaning_language", 0.2, f"{n_of('l', V.LEFT_PHRASES)} > 2 * {n_of('l', V.RIGHT_PHRASES)}"),
        ("right_leaning_language", 0.2, f"{n_of('l', V.RIGHT_PHRASES)} > 2 * {n_of('l', V.LEFT_PHRASES)}"),
        ("loaded_language", 0.15, f"{n_of('l', V.LOADED_PHRASES)} > 3"),
        ("one_sided_argument", 0.1, f"{n_of('l', V.BALANCE_PHRASES)} = 0 AND {u16('l')} > 500"),
        ("excessive_emotional_language", 0.15, f"{n_of('l', V.EMOTIONAL_PHRASES)} > 5"),
    ],
    "antiManipulation": [
        ("urgency_pressure", 0.3, f"{n_of('l', V.URGENCY_PHRASES)} > 2"),
        ("financial_scam_indicators", 0.4, f"{n_of('l', V.FINANCIAL_PHRASES)} > 2"),
        ("suspicious_domain", 0.2, r"regexp_matches(domain, '(\.tk|\.ml|\.ga|\.cf)\z|bit\.ly|tinyurl|short\.link|[0-9]{4,}')"),
        ("suspicious_links", 0.15, rf"regexp_matches({LINK_HOST}, '(\.tk|\.ml|\.ga|\.cf)\z|bit\.ly|tinyurl')"),
        ("personal_info_request", 0.35, f"{n_of('l', V.PERSONAL_INFO_PHRASES)} > 1"),
        ("poor_grammar_quality", 0.1, f"{n_of('l', V.SHORT_BAIT_PHRASES)} > 0 AND {u16('l')} < 300"),
    ],
    "defuseRagebait": [
        ("profanity", 0.15, any_re("l", V.PROFANITY_PATTERNS)),
        ("hate_speech", 0.4, any_re("l", V.HATE_PATTERNS)),
        ("harassment", 0.35, any_re("l", V.HARASSMENT_PATTERNS)),
        ("threats", 0.4, any_re("l", V.THREAT_PATTERNS)),
        ("personal_attacks", 0.2, any_re("l", V.ATTACK_PATTERNS)),
    ],
    "clickUnbait": [
        (flag, weight, f"regexp_matches(concat(lt, ' ', l), {re2(pattern)})")
        for flag, weight, pattern in V.CLICKBAIT_PATTERNS
    ],
}
ANY_BAIT = "(" + " OR ".join(c for _, _, c in RULES["clickUnbait"]) + ")"
BONUS = f"(CASE WHEN {ANY_BAIT} AND regexp_matches(lt, {re2(V.VAGUE_TITLE_PATTERN)}) AND {u16('title')} < 80 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)"


def score_of(module: str) -> str:
    raw = total(RULES[module])
    if module == "clickUnbait":
        raw = f"({raw} + {BONUS})"
    return f"least({raw}, 1::DOUBLE)"


def scored(module: str) -> str:
    """doc_id, source, score and flags of one module."""
    rules = RULES[module]
    extra = ", CASE WHEN score >= 0.4 THEN 'clickbait' END" if module == "clickUnbait" else ""
    hits = ", ".join(f"({c}) AS h{i}" for i, (_, _, c) in enumerate(rules))
    named = [(f, w, f"h{i}") for i, (f, w, _) in enumerate(rules)]
    return f"""(SELECT *, {names(named, extra)} AS flags FROM
        (SELECT doc_id, source, {hits}, {score_of(module)} AS score FROM base))"""


def say(module: str) -> str:
    if module == "biasDetector":
        low, mid, high = V.BIAS_EXPLANATIONS
        way = "CASE WHEN h0 THEN 'left-leaning' WHEN h1 THEN 'right-leaning' ELSE 'neutral' END"
        text = lambda t: f"concat({lit(t[0])}, {way}, {lit(t[1])}, flags, {lit(t[2])})"
        return f"CASE WHEN score < 0.2 THEN {lit(low)} WHEN score < 0.5 THEN {text(mid)} ELSE {text(high)} END"
    if module == "clickUnbait":
        shown = "concat_ws(', ', " + ", ".join(
            f"CASE WHEN h{i} THEN {lit(f)} END" for i, (f, _, _) in enumerate(RULES[module])) + ")"
        return (f"CASE WHEN score >= 0.4 THEN concat('Clickbait patterns: ', coalesce(nullif({shown}, ''), "
                "'sensational framing'), '.') ELSE 'Headline appears reasonably descriptive.' END")
    low, mid, high = V.MANIPULATION_EXPLANATIONS if module == "antiManipulation" else V.TOXICITY_EXPLANATIONS
    tail = "''"
    if module == "defuseRagebait":
        parts = ", ".join(f"CASE WHEN h{i} THEN {lit(c)} END" for i, c in enumerate(
            ["profanity", "hate speech", "harassment", "threats"]))
        tail = f"coalesce(concat('Categories: ', nullif(concat_ws(', ', {parts}), ''), '.'), '')"
        tail = f"CASE WHEN concat_ws(', ', {parts}) <> '' THEN concat('Categories: ', concat_ws(', ', {parts}), '.') ELSE '' END"
    return (f"CASE WHEN score < 0.2 THEN {lit(low)} WHEN score < 0.5 THEN concat({lit(mid[0])}, flags, {lit(mid[1])}) "
            f"ELSE concat({lit(high[0])}, flags, {lit(high[1])}, {tail}) END")


def conf(module: str) -> str:
    return {"biasDetector": "0.6", "antiManipulation": "0.65", "defuseRagebait": "0.6",
            "clickUnbait": "CASE WHEN flags <> '' THEN 0.65 ELSE 0.5 END"}[module]


def module_scores(module: str) -> str:
    return f"""WITH {BASE} SELECT doc_id, round(score, 6) AS problem_score, {conf(module)}::DOUBLE AS confidence,
        flags, {say(module)} AS explanation FROM {scored(module)}"""


HEURISTIC = ["biasDetector", "antiManipulation", "defuseRagebait", "clickUnbait"]
LONG = " UNION ALL ".join(
    f"SELECT doc_id, source, {lit(m)} AS module, {lit(V.MODULE_ASPECT[m])} AS aspect, {MODULES.index(m)} AS place, score, "
    f"{conf(m)}::DOUBLE AS confidence, flags, {say(m)} AS explanation FROM {scored(m)}" for m in HEURISTIC)


def band(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.8 THEN 'very-high' WHEN {x} >= 0.6 THEN 'high' WHEN {x} >= 0.4 THEN 'medium' "
            f"WHEN {x} >= 0.2 THEN 'low' WHEN {x} > 0 THEN 'very-low' ELSE 'unknown' END")


# Per chunk: scores side by side in module order, added in that order.
WIDE = f"""wide AS (SELECT doc_id, any_value(source) AS source,
    list(score ORDER BY place) AS ss, list(confidence ORDER BY place) AS cs,
    list(coalesce(nullif(split_part(flags, ', ', 1), ''), aspect) ORDER BY place) AS labels,
    list(flags ORDER BY place) AS fs, list(module ORDER BY place) AS ms, list(aspect ORDER BY place) AS ts
    FROM long GROUP BY doc_id)"""
MEAN = "list_reduce(ss, lambda a, b: a + b) / len(ss)"
SUMMARY = f"""summary AS (SELECT doc_id, source, {MEAN} AS problem_score,
    list_reduce(cs, lambda a, b: a + b) / len(cs) AS confidence, labels, ss, ts FROM wide)"""
CHUNK_CTES = f"WITH {BASE}, long AS ({LONG}), {WIDE}, {SUMMARY}"

# Per source (as page) and module. Flags in order of first appearance.
FLAG_ROWS = """flag_rows AS (SELECT source, module, flag, min(doc_id * 100 + nr) AS first_at FROM (
    SELECT source, module, doc_id, unnest(string_split(flags, ', ')) AS flag,
      generate_subscripts(string_split(flags, ', '), 1) AS nr FROM long WHERE flags <> '') GROUP BY ALL)"""
PAGE_MODULES = f"""{CHUNK_CTES}, {FLAG_ROWS},
  flag_list AS (SELECT source, module, string_agg(flag, ', ' ORDER BY first_at) AS flags FROM flag_rows GROUP BY ALL),
  page_modules AS (SELECT l.source, l.module, any_value(l.place) AS place, avg(score) AS problem_score,
    arg_min(explanation, doc_id) AS explanation, count(*) AS n_chunks FROM long l GROUP BY l.source, l.module),
  pages_ AS (SELECT source, list_reduce(list(problem_score ORDER BY place), lambda a, b: a + b) / count(*) AS score
    FROM page_modules GROUP BY source)"""

SQL: dict[str, str] = {}
SQL["bias_by_source"] = f"""WITH {BASE}, s AS (SELECT source, score, {band('score')} AS risk FROM {scored('biasDetector')})
    SELECT source, risk, count(*) AS n_chunks, round(avg(score) + 1e-10, 6) AS mean_score FROM s GROUP BY source, risk"""
SQL["bias_scores"] = module_scores("biasDetector")
SQL["manipulation_scores"] = module_scores("antiManipulation")
SQL["toxicity_scores"] = module_scores("defuseRagebait")
SQL["clickbait_scores"] = module_scores("clickUnbait")
SQL["aspect_long"] = f"""WITH {BASE}, long AS ({LONG}) SELECT doc_id, module, aspect, concat(module, '-', doc_id) AS id,
    module AS method, 'heuristic' AS model, round(score, 6) AS problem_score, confidence, flags, explanation,
    NULL::VARCHAR AS error, module AS module_id FROM long"""
SQL["chunk_summary"] = f"""{CHUNK_CTES} SELECT doc_id, round(problem_score + 1e-10, 6) AS problem_score,
    round(confidence, 6) AS confidence, {band('problem_score')} AS overall_risk,
    CASE WHEN problem_score >= 0.6 THEN {lit(V.SUMMARY_TEXTS['high'])} WHEN problem_score >= 0.4
      THEN {lit(V.SUMMARY_TEXTS['medium'])} ELSE {lit(V.SUMMARY_TEXTS['low'])} END AS summary_text,
    array_to_string(labels, '|') AS labels,
    array_to_string(list_transform(ss, lambda x: {band('x')}), '|') AS ratings, array_to_string(ts, '|') AS types FROM summary"""
SQL["nutrition_label"] = f"""{CHUNK_CTES} SELECT doc_id,
    CASE WHEN {MEAN} >= 0.7 THEN 'High Risk' WHEN {MEAN} >= 0.4 THEN 'Caution' ELSE 'Safe' END AS label,
    round({MEAN}, 6) AS score, coalesce(array_to_string(list_filter(fs, lambda x: x <> ''), ', '), '') AS flags,
    ms[list_position(ss, list_max(ss))] AS highest_module, round(list_max(ss), 6) AS highest_score FROM wide"""
SQL["page_module_rollup"] = f"""{PAGE_MODULES} SELECT p.source, p.module, round(problem_score + 1e-10, 6) AS problem_score,
    0.8::DOUBLE AS confidence, coalesce(flags, '') AS flags, explanation, n_chunks
    FROM page_modules p LEFT JOIN flag_list f ON p.source = f.source AND p.module = f.module"""
VERDICT = "CASE WHEN score > 0.7 THEN 'high-risk' WHEN score > 0.4 THEN 'caution' ELSE 'safe' END"
SQL["page_verdict"] = f"""{PAGE_MODULES}, n AS (SELECT source, count(*) FILTER (problem_score >= 0.4) AS neutralised,
    count(*) AS n_chunks FROM summary GROUP BY source)
    SELECT source, round(score + 1e-10, 6) AS score, {VERDICT} AS overall, round((1 - score) * 100 + 1e-9, 1) AS safe_percent,
    neutralised, n_chunks FROM pages_ JOIN n USING (source)"""
SQL["result_table"] = f"""{PAGE_MODULES} SELECT source, module, round(problem_score * 100 + 1e-9, 0)::INT AS score_percent,
    80 AS confidence_percent, CASE WHEN problem_score < 0.3 THEN 'low' WHEN problem_score < 0.6 THEN 'medium'
    ELSE 'high' END AS band FROM page_modules"""
SQL["display_bands"] = f"""{CHUNK_CTES} SELECT doc_id, CASE WHEN problem_score < 0.3 THEN 'low'
    WHEN problem_score < 0.6 THEN 'medium' ELSE 'high' END AS band, problem_score >= 0.4 AS neutralised,
    concat(substr(text, 1, 120), CASE WHEN length(text) > 120 THEN '…' ELSE '' END) AS text_preview
    FROM summary JOIN base USING (doc_id)"""
SQL["toxicity_vs_labels"] = f"""WITH {BASE}, s AS (SELECT doc_id, {band('score')} AS risk FROM {scored('defuseRagebait')})
    SELECT risk, toxic, quality, count(*) AS n FROM s JOIN labels USING (doc_id) GROUP BY ALL"""
