"""Checked queries over claims, fact checks and clickbait."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.oracle import BASE, RULES, SQL, flat, lit, names, re2, score_of, trim, u16
from checks.page_checks import HOST, ORIGIN, PATH, TITLE, EXCERPT, TAGLESS, joined
from checks.queries import query
from pagegauge import fixed_values as V
from pagegauge.functions import text as T, urls as U
from pagegauge.operators import chunks as H, claims as C, clickbait as B, scorers as S

# --- claims ----------------------------------------------------------------------

SENTENCES = f"""list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {trim('s')}), lambda s: {u16('s')} >= 20)"""
IS_CLAIM = " OR ".join(f"regexp_matches(s, {re2('(?i)' + p)})" for p in V.CLAIM_PATTERNS)


def claims_of(source: str) -> str:
    """doc_id, text and the list of claims."""
    return f"""(SELECT doc_id, text, CASE WHEN len(found) > 0 THEN found ELSE sents END AS claims FROM (
      SELECT *, list_filter(sents, lambda s: {IS_CLAIM}) AS found FROM (
      SELECT doc_id, text, {SENTENCES} AS sents FROM {source})))"""


CLAIM_ROWS = f"""(SELECT doc_id, unnest(claims) AS claim, generate_subscripts(claims, 1) - 1 AS claim_pos
    FROM {claims_of('documents')})"""


@query
def claims(spark, sf):
    return C.extract_claims(I.documents(spark, sf), ["doc_id"])


SQL["claims"] = f"SELECT doc_id, claim_pos::INT AS claim_pos, claim FROM {CLAIM_ROWS}"


@query
def statements(spark, sf):
    rows = C.extract_statements(I.documents(spark, sf), ["doc_id"])
    return rows.select(
        "doc_id", F.size("statements").alias("n"),
        F.array_join(F.transform("statements", lambda s: F.concat(s["type"], F.lit(": "), s["summary_text"])), "|").alias("said"))


SQL["statements"] = f"""SELECT doc_id, len(claims)::INT AS n,
    array_to_string(list_transform(claims, lambda c: concat('claim: ', c)), '|') AS said FROM {claims_of('documents')}"""

# --- fact checks --------------------------------------------------------------------

_BENCH = f"""SELECT item_id * 1000 + unnest(generate_series(0, len(sents) - 1)) AS fact_id, unnest(sents) AS text
    FROM (SELECT item_id, {SENTENCES} AS sents FROM benchmark) WHERE len(sents) > 0"""
_SAID = f"""SELECT doc_id * 1000000 + {I.DOCUMENT_FACTS} + unnest(generate_series(0, len(sents) - 1)) AS fact_id, unnest(sents) AS text
    FROM (SELECT doc_id, {SENTENCES} AS sents FROM documents) WHERE len(sents) > 0"""
VALUE = "CASE lower({0}) " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in V.RATING_SCORES.items()) + " ELSE 0.5::DOUBLE END"
_R1, _R2 = VALUE.format(I.RATING.format("fact_id")), VALUE.format(I.RATING.format("(fact_id + 3)"))
FACTS = f"""facts AS (SELECT fact_id, text, lower({flat('text')}) AS claim_key, {I.RATING.format('fact_id')} AS rating_word,
      fact_id % 5 AS kind,
      CASE fact_id % 5 WHEN 4 THEN {_R1} WHEN 2 THEN {_R1} WHEN 3 THEN ({_R1} + {_R2}) / 2 ELSE 0.5::DOUBLE END AS rating
      FROM ({_BENCH} UNION ALL {_SAID})),
    verdicts AS (SELECT claim_key, min(fact_id) AS fact_id, arg_min(rating, fact_id) AS rating, count(*) AS n_results
      FROM facts GROUP BY claim_key)"""
MATCHED = f"""m AS (SELECT c.*, v.fact_id, v.rating, v.n_results FROM (SELECT *, lower({flat('claim')}) AS claim_key FROM {CLAIM_ROWS}) c
    LEFT JOIN verdicts v USING (claim_key))"""


@query
def fact_check_matches(spark, sf):
    found = C.extract_claims(I.documents(spark, sf), ["doc_id"])
    return C.match_fact_checks(found, I.fact_checks(spark, sf)).select(
        "doc_id", "claim_pos", "fact_id", F.round("rating", 6).alias("rating"), "n_results")


SQL["fact_check_matches"] = f"""WITH {FACTS}, {MATCHED} SELECT doc_id, claim_pos::INT AS claim_pos, fact_id,
    round(rating, 6) AS rating, n_results FROM m"""


@query
def accuracy_scores(spark, sf):
    scores = C.score_accuracy(I.documents(spark, sf), I.fact_checks(spark, sf), ["doc_id"])
    return scores.select(
        "doc_id", F.round("problem_score", 6).alias("problem_score"), "confidence", joined("flags").alias("flags"),
        "explanation", F.col("metadata")["claimsChecked"].alias("checked"), F.col("metadata")["factChecksFound"].alias("found"))


_E = V.FACT_CHECK_EXPLANATIONS
_LESS = lambda a, b, c, d: f"CASE WHEN a < 0.3 THEN {a} WHEN a < 0.5 THEN {b} WHEN a > 0.7 THEN {c} ELSE {d} END"
SQL["accuracy_scores"] = f"""WITH {FACTS}, {MATCHED},
    g AS (SELECT d.doc_id, any_value(d.text) AS text, count(m.claim) AS n_claims, count(m.rating) AS n_found,
      coalesce(sum(n_results), 0)::BIGINT AS n_checks,
      CASE WHEN count(m.rating) > 0 THEN list_reduce(list(m.rating ORDER BY claim_pos) FILTER (m.rating IS NOT NULL), lambda a, b: a + b) / count(m.rating)
        ELSE 0.5::DOUBLE END AS a FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id),
    k AS (SELECT *, CASE WHEN {u16('text')} < 10 THEN 'short' WHEN n_claims = 0 THEN 'none' WHEN n_found = 0 THEN 'unknown' ELSE 'found' END AS k FROM g)
    SELECT doc_id, round(CASE WHEN k IN ('short', 'none') THEN 0.5::DOUBLE ELSE 1 - a END, 6) AS problem_score,
      CASE k WHEN 'found' THEN 0.8::DOUBLE WHEN 'unknown' THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS confidence,
      CASE k WHEN 'short' THEN 'insufficient_content' WHEN 'none' THEN 'no_claims_found' WHEN 'unknown' THEN 'no_fact_checks_found'
        ELSE {_LESS("'fact_checked,mostly_false'", "'fact_checked,partially_false'", "'fact_checked,mostly_true'", "'fact_checked'")} END AS flags,
      CASE k WHEN 'short' THEN {lit(_E['too_short'])} WHEN 'none' THEN {lit(_E['no_claims'])} WHEN 'unknown' THEN {lit(_E['none_found'])}
        ELSE concat({lit(_E['prefix'][0])}, n_checks, {lit(_E['prefix'][1])}, {_LESS(lit(_E['mostly_false']), lit(_E['partially_false']), lit(_E['mostly_true']), lit(_E['other']))}) END AS explanation,
      CASE WHEN k NOT IN ('short', 'none') THEN n_claims::VARCHAR END AS checked,
      CASE WHEN k NOT IN ('short', 'none') THEN n_found::VARCHAR END AS found FROM k"""


@query
def fact_check_report(spark, sf):
    found = C.extract_claims(I.documents(spark, sf), ["doc_id"])
    return C.fact_check_report(found, I.fact_checks(spark, sf), ["doc_id"]).select(
        "doc_id", "claim_pos", "n_claims", "claim", "fact_id", "rating", "band", "publisher", "title", "url")


_CUT = lambda x, n: f"concat(substr({x}, 1, {n}), CASE WHEN length({x}) > {n} THEN '...' ELSE '' END)"
_WORD = "CASE WHEN kind IN (2, 3, 4) THEN rating_word ELSE 'Unknown' END"
SQL["fact_check_report"] = f"""WITH {FACTS}, j AS (SELECT c.*, f.fact_id, f.kind, f.text AS fact, {_WORD} AS word
      FROM (SELECT *, lower({flat('claim')}) AS claim_key, count(*) OVER (PARTITION BY lower({flat('claim')})) AS n_claims FROM {CLAIM_ROWS}
        QUALIFY row_number() OVER (PARTITION BY claim_key ORDER BY doc_id, claim_pos) = 1) c LEFT JOIN facts f USING (claim_key))
    SELECT doc_id, claim_pos::INT AS claim_pos, n_claims, {_CUT('claim', 150)} AS claim, fact_id,
      CASE WHEN fact_id IS NULL THEN 'none found' ELSE word END AS rating,
      CASE WHEN fact_id IS NULL THEN NULL WHEN lower(word) LIKE '%false%' OR lower(word) LIKE '%pants on fire%' THEN 'false'
        WHEN lower(word) LIKE '%true%' THEN 'true' WHEN lower(word) = 'mixture' THEN 'mixture' ELSE 'other' END AS band,
      CASE WHEN fact_id IS NULL THEN NULL WHEN kind IN (3, 4) THEN 'Desk' WHEN kind = 2 THEN 'Unknown' ELSE 'Unknown Publisher' END AS publisher,
      CASE WHEN kind IN (2, 3, 4) THEN {_CUT("concat('Review of: ', fact)", 120)} END AS title,
      CASE WHEN kind IN (2, 3, 4) THEN concat('https://check.example.org/', fact_id) END AS url FROM j"""


@query
def page_fact_checks(spark, sf):
    found = C.extract_claims(I.documents(spark, sf), ["doc_id", "source"])
    matches = C.match_fact_checks(found, I.fact_checks(spark, sf))
    return C.page_fact_checks(matches, ["source"]).withColumn(
        "average_rating", F.round(F.col("average_rating") + 1e-10, 6))


SQL["page_fact_checks"] = f"""WITH {FACTS}, {MATCHED} SELECT source, count(claim) AS claims_checked,
    count(rating) AS fact_checks_found, round(avg(rating) + 1e-10, 6) AS average_rating
    FROM m JOIN documents USING (doc_id) GROUP BY source"""


@query
def claim_near_matches(spark, sf):
    """Every pair of a document's claim and a benchmark sentence that share 60 % of their words."""
    found = C.extract_claims(I.documents(spark, sf), ["doc_id"]).select(C.normalize_claim(F.col("claim")).alias("claim_key"))
    known = I.sentences(spark, I.table(spark, sf, "benchmark"), "item_id", 1000).select(
        C.normalize_claim(F.col("text")).alias("claim_key"))
    return C.similar_texts(found, known, 0.6).withColumn("similarity", F.round("similarity", 6))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
SQL["claim_near_matches"] = f"""WITH a AS (SELECT DISTINCT lower({flat('claim')}) AS claim_key FROM {CLAIM_ROWS}),
    b AS (SELECT DISTINCT lower({flat('text')}) AS match_key FROM ({_BENCH})),
    x AS (SELECT claim_key, {_SET.format('claim_key')} AS ws FROM a), y AS (SELECT match_key, {_SET.format('match_key')} AS vs FROM b),
    p AS (SELECT claim_key, match_key, len(list_intersect(ws, vs)) / (len(ws) + len(vs) - len(list_intersect(ws, vs)))::DOUBLE AS s FROM x, y
      WHERE len(ws) > 0 AND len(vs) > 0)
    SELECT claim_key, match_key, round(s, 6) AS similarity FROM p WHERE s >= 0.6 - 1e-9"""


@query
def fact_check_nearest(spark, sf):
    """Claims of documents with the verdict on the most similar benchmark sentence that shares 60 % of their words."""
    found = C.extract_claims(I.documents(spark, sf), ["doc_id"])
    known = I.fact_checks(spark, sf, said=False)
    return C.match_fact_checks(found, known, "fuzzy", 0.6).select(
        "doc_id", "claim_pos", "fact_id", F.round("rating", 6).alias("rating"), "n_results")


SQL["fact_check_nearest"] = f"""WITH {FACTS},
    known AS (SELECT claim_key, min(fact_id) AS fact_id, arg_min(rating, fact_id) AS rating, count(*) AS n_results
      FROM facts WHERE fact_id < {I.DOCUMENT_FACTS} GROUP BY claim_key),
    c AS (SELECT doc_id, claim_pos, lower({flat('claim')}) AS claim_key FROM {CLAIM_ROWS}),
    x AS (SELECT claim_key, {_SET.format('claim_key')} AS ws FROM (SELECT DISTINCT claim_key FROM c)),
    y AS (SELECT claim_key AS match_key, {_SET.format('claim_key')} AS vs FROM known),
    p AS (SELECT claim_key, match_key, len(list_intersect(ws, vs)) / (len(ws) + len(vs) - len(list_intersect(ws, vs)))::DOUBLE AS s FROM x, y
      WHERE len(ws) > 0 AND len(vs) > 0 AND least(len(ws), len(vs)) >= 0.6 * greatest(len(ws), len(vs)) - 1e-9),
    best AS (SELECT claim_key, match_key FROM p WHERE s >= 0.6 - 1e-9
      QUALIFY row_number() OVER (PARTITION BY claim_key ORDER BY s DESC, match_key) = 1)
    SELECT doc_id, claim_pos::INT AS claim_pos, k.fact_id, round(k.rating, 6) AS rating, k.n_results
    FROM c LEFT JOIN best b ON b.claim_key = c.claim_key LEFT JOIN known k ON k.claim_key = b.match_key"""


@query
def rating_bands(spark, sf):
    facts = I.fact_checks(spark, sf)
    return facts.select(
        "fact_id", F.round(C.rating_score(F.col("reviews")), 6).alias("rating"),
        C.rating_band(F.get("reviews", F.lit(0))["textual_rating"]).alias("band"))


SQL["rating_bands"] = f"""WITH {FACTS} SELECT fact_id, round(rating, 6) AS rating, CASE WHEN kind NOT IN (2, 3, 4) THEN 'other'
    WHEN lower(rating_word) LIKE '%false%' OR lower(rating_word) LIKE '%pants on fire%' THEN 'false'
    WHEN lower(rating_word) LIKE '%true%' THEN 'true' WHEN lower(rating_word) = 'mixture' THEN 'mixture' ELSE 'other' END AS band FROM facts"""

# --- clickbait -----------------------------------------------------------------------
# Every document is a chunk of one page and links to another one.

# More page numbers than there are pages, so some links and own pages lead nowhere.
_PAGES_N = "(SELECT count(*) * 6 // 5 + 1 FROM pages)"
_LINKS_TO = "CASE WHEN doc_id % 13 = 0 THEN 'javascript:void(0)' WHEN doc_id % 7 = 0 THEN concat('#', doc_id) ELSE target_url END"


def _bait(spark, sf):
    docs = I.chunks(spark, sf).drop("links")
    pages = I.table(spark, sf, "pages").select("page_id", "url")
    n = pages.count() * 6 // 5 + 1
    chunk = docs.withColumn("page_id", F.col("doc_id") % n).withColumn("goal", (F.col("doc_id") * 7 + 1) % n)
    at = chunk.join(pages.withColumnRenamed("url", "page_url"), "page_id", "left").join(
        pages.select(F.col("page_id").alias("goal"), F.col("url").alias("target_url")), "goal", "left")
    href = F.expr(_LINKS_TO)
    links = F.array(
        F.struct(F.lit("mailto:a@example.org").alias("url"), F.lit("mail").alias("text")),
        F.struct(F.concat(F.col("page_url"), F.lit("#here")).alias("url"), F.lit("same page again").alias("text")),
        F.struct(href.alias("url"), F.lit(" go ").alias("text")))
    return S.score(at.withColumn("links", links), "clickUnbait", ["doc_id", "page_id", "title", "text", "links", "page_url"])


@query
def unravel_clickbait(spark, sf):
    done = B.unravel_clickbait(_bait(spark, sf), I.pages(spark, sf), key=["doc_id"])
    return done.select(
        "doc_id", F.round("problem_score", 6).alias("problem_score"), joined("flags").alias("flags"), "outcome",
        "explanation", "destination_url", "original_title", "honest_summary", "display_title", "hover_title")


_HITS = [(f, w, f"h{i}") for i, (f, w, _) in enumerate(RULES["clickUnbait"])]
_KEY = f"concat({ORIGIN}, {PATH}, regexp_extract(url, '(\\?[^#]*)', 1))"
_NORM = f"concat({ORIGIN}, {PATH}, regexp_extract(url, '([?#].*)', 1))"
_WORDS8 = lambda x: f"array_to_string(list_slice(string_split({x}, ' '), 1, 8), ' ')"
_SENT = flat("regexp_extract(dest_text, '^([^.!?]*)', 1)")
SQL["unravel_clickbait"] = f"""WITH {BASE},
    s AS (SELECT *, {", ".join(f"({c}) AS h{i}" for i, (_, _, c) in enumerate(RULES["clickUnbait"]))}, {score_of("clickUnbait")} AS score FROM base),
    bait AS (SELECT *, doc_id % {_PAGES_N} AS page_id, (doc_id * 7 + 1) % {_PAGES_N} AS goal, {names(_HITS, ", 'clickbait'")} AS flags,
      {names(_HITS)} AS shown FROM s WHERE score >= 0.4),
    pg AS (SELECT page_id, url, {_KEY} AS key, {_NORM} AS norm, {TITLE} AS dest_title, {EXCERPT} AS dest_text FROM pages),
    j AS (SELECT b.*, p.url AS page_url, g.url AS target_url, g.norm AS target_norm, g.key AS target_key, p.key AS own_key
      FROM bait b LEFT JOIN pg p ON b.page_id = p.page_id LEFT JOIN pg g ON b.goal = g.page_id),
    t AS (SELECT *, CASE WHEN doc_id % 13 = 0 OR doc_id % 7 = 0 THEN NULL
        WHEN split_part(target_key, '?', 1) = split_part(own_key, '?', 1) THEN NULL ELSE target_norm END AS dest_url,
      coalesce(nullif({trim('title')}, ''), 'same page again') AS original FROM j),
    d AS (SELECT t.*, f.page_id AS dest_id, f.dest_title, f.dest_text FROM t LEFT JOIN (SELECT * FROM pg
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1) f ON t.dest_url IS NOT NULL AND t.target_key = f.key
      AND (f.dest_title <> '' OR f.dest_text <> '')),
    h AS (SELECT *, CASE WHEN dest_title <> '' AND lower(dest_title) <> lower(original)
        THEN nullif({trim(f"regexp_replace({_WORDS8('dest_title')}, '[|:].*', '')")}, '')
        WHEN {u16(_SENT)} > 12 THEN {_WORDS8(_SENT)} END AS summary FROM d),
    w AS (SELECT *, {trim(f"regexp_replace({trim('summary')}, '^\\[+|\\]+$', '', 'g')")} AS short, {flat('original')} AS whole FROM h),
    o AS (SELECT *, CASE WHEN dest_url IS NULL THEN 'no_link' WHEN dest_id IS NULL THEN 'no_page' WHEN summary IS NULL THEN 'no_summary'
      WHEN short = '' OR whole = '' THEN 'no_rewrite' ELSE 'unbaited' END AS outcome FROM w)
    SELECT doc_id, round(score, 6) AS problem_score,
      concat(replace(flags, ', ', ','), CASE WHEN outcome = 'unbaited' THEN ',unbaited' ELSE '' END) AS flags, outcome,
      CASE WHEN outcome = 'unbaited' THEN concat('Unbaited: ', summary)
        ELSE concat('Clickbait patterns: ', coalesce(nullif(shown, ''), 'sensational framing'), '.') END AS explanation,
      dest_url AS destination_url, CASE WHEN outcome <> 'no_link' THEN original END AS original_title,
      CASE WHEN outcome = 'unbaited' THEN summary END AS honest_summary,
      CASE WHEN outcome = 'unbaited' THEN concat('[', short, '] ', CASE WHEN length(short) + 3 + length(whole) <= 90 THEN whole
        WHEN 89 - length(short) - 3 > 0 THEN concat(rtrim(substr(whole, 1, 89 - length(short) - 3)), '…') ELSE '…' END) END AS display_title,
      CASE WHEN outcome = 'unbaited' THEN whole END AS hover_title FROM o"""


@query
def title_targets(spark, sf):
    """Which link or heading of an article carries the page title."""
    from pagegauge.operators.extract import extract_chunks
    pages = I.pages(spark, sf)
    titles = pages.select("page_id", H.html_title(F.col("html")).alias("page_title"))
    chunks = extract_chunks(pages).join(titles, "page_id")
    target = B.title_target(
        F.transform("links", lambda x: x["text"]), F.col("page_title"), F.array(F.col("title"), F.lit("Other")))
    return chunks.select("page_id", target.alias("t")).select("page_id", "t.kind", "t.pos")


@query
def summary_cleanup(spark, sf):
    """Model summaries out of reply texts: JSON, bracketed, quoted, plain."""
    docs = I.documents(spark, sf)
    text = T.collapse_space(F.col("text"))
    reply = F.expr("doc_id % 4")
    made = F.when(reply == 0, F.concat(F.lit("[["), text, F.lit("]]"))).when(
        reply == 1, F.concat(F.lit('"'), F.regexp_replace(text, '"', ""), F.lit('"'))).when(
        reply == 2, F.concat(F.lit("\n  \n"), text, F.lit("\nmore"))).otherwise(
        F.concat(F.lit('Sure: {"summary": "'), F.regexp_replace(text, r'["\\\\{}]', ""), F.lit('", "explanation": "x"}')))
    return docs.select("doc_id", B.parse_summary_reply(made).alias("summary"))


_SHORT = flat("text")
_OUT = lambda x: f"substr({flat(f'''regexp_replace(regexp_replace({x}, '^\\[+|\\]+$', '', 'g'), '^[\"\'\']|[\"\'\']$', '', 'g')''')}, 1, 60)"
_HEAD = flat(TAGLESS.format("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)"))
SQL["title_targets"] = f"""WITH p AS (SELECT page_id, lower(coalesce(nullif({_HEAD}, ''), '')) AS h, lower({TITLE}) AS t,
      {u16(trim(TAGLESS.format("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")))} AS n FROM pages)
    SELECT page_id, CASE WHEN contains(h, substr(t, 1, 40)) OR contains('other', substr(t, 1, 40)) THEN 'heading' END AS kind,
      CASE WHEN contains(h, substr(t, 1, 40)) THEN 0 WHEN contains('other', substr(t, 1, 40)) THEN 1 END AS pos FROM p WHERE n >= 100"""
_MADE = f"""CASE doc_id % 4 WHEN 0 THEN concat('[[', {_SHORT}, ']]') WHEN 1 THEN concat('"', replace({_SHORT}, '"', ''), '"')
    WHEN 2 THEN concat(chr(10), '  ', chr(10), {_SHORT}, chr(10), 'more')
    ELSE concat('Sure: {{"summary": "', regexp_replace({_SHORT}, '["\\\\{{}}]', '', 'g'), '", "explanation": "x"}}') END"""
SQL["summary_cleanup"] = f"""WITH r AS (SELECT doc_id, {_MADE} AS reply FROM documents),
    j AS (SELECT *, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS obj,
      list_filter(list_transform(string_split(reply, chr(10)), lambda x: {trim('x')}), lambda x: x <> '' AND NOT starts_with(x, '{{')) AS lines FROM r),
    s AS (SELECT doc_id, coalesce(CASE WHEN json_valid(obj) THEN nullif({trim("(obj::JSON)->>'$.summary'")}, '') END, lines[1]) AS said FROM j)
    SELECT doc_id, {_OUT('said')} AS summary FROM s"""
