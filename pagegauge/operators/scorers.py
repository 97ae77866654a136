"""Aspect scorers: rules over the chunk text, as plain Catalyst expressions.

A scorer is a list of rules (flag, weight, condition).  The score is the sum
of the weights of the rules that hold, the flags are their names.  `score_all`
evaluates the rules of all modules in three narrow projections (conditions,
then scores and flags, then explanations), so no condition is evaluated twice
and nothing is shuffled, and turns each chunk into one row per module.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.functions.urls import url_host


@dataclass(frozen=True)
class ChunkView:
    """Names of the columns a scorer may read. Missing chunk columns read as empty."""

    text: str = "_text"
    lower: str = "_lower"
    title: str = "_title"
    lower_title: str = "_lower_title"
    both: str = "_both"
    domain: str = "_domain"
    bad_link: str = "_bad_link"


Rules = list[tuple[str, float, Column]]


@dataclass(frozen=True)
class Scorer:
    module: str
    aspect: str
    rules: Callable[[ChunkView], Rules]
    confidence: Callable[[Column, Column], Column]
    explanation: Callable[[Column, Column, dict], Column]
    metadata: Callable[[dict], Column] = lambda hits: F.lit(None).cast("map<string,string>")
    # Flags that follow from the score, given by its column name, as SQL conditions.
    extra_flags: Callable[[str], list[tuple[str, str]]] = lambda score: []
    # Weights without a flag: (weight, condition on the hits and the chunk).
    bonus: Callable[[ChunkView, dict], list[tuple[float, Column]]] = lambda view, hits: []
    # A strict scorer fails on a chunk for which a condition is null: write conditions with
    # try_ functions (try_cast, try_divide, try_to_timestamp, ...) over columns of the user's.
    strict: bool = False


SCORERS: dict[str, Scorer] = {}


def register_scorer(scorer: Scorer) -> Scorer:
    """Add a scoring module; it takes part in score_all from then on."""
    SCORERS[scorer.module] = scorer
    return scorer


def _fixed(value: float):
    return lambda score, flags: F.lit(value)


def _banded(texts, flags: Column, score: Column, tail: Column | None = None) -> Column:
    low, mid, high = texts
    joined = F.array_join(flags, ", ")
    end = [tail] if tail is not None else []
    return (
        F.when(score < 0.2, low)
        .when(score < 0.5, F.concat(F.lit(mid[0]), joined, F.lit(mid[1])))
        .otherwise(F.concat(F.lit(high[0]), joined, F.lit(high[1]), *end))
    )


# --- manipulation -------------------------------------------------------------

def _ends_or_contains(host: Column, endings: list[str], parts: list[str]) -> Column:
    return T.any_of([F.endswith(host, F.lit(e)) for e in endings] + [F.contains(host, F.lit(p)) for p in parts])


def _bad_link(links: Column) -> Column:
    """Some link leads to a suspicious host. The size test spares the lambda."""
    suspicious = lambda h: _ends_or_contains(h, V.SUSPICIOUS_HOST_ENDINGS, V.SUSPICIOUS_LINK_PARTS)
    some = F.exists(links, lambda x: T.let(url_host(x["url"]), suspicious))
    return F.when(F.size(links) > 0, F.coalesce(some, F.lit(False))).otherwise(False)


def _manipulation_rules(v: ChunkView) -> Rules:
    domain = F.col(v.domain)
    return [
        ("urgency_pressure", 0.3, T.more_than(v.lower, V.URGENCY_PHRASES, 2)),
        ("financial_scam_indicators", 0.4, T.more_than(v.lower, V.FINANCIAL_PHRASES, 2)),
        ("suspicious_domain", 0.2, (domain != "") & (
            _ends_or_contains(domain, V.SUSPICIOUS_HOST_ENDINGS, V.SUSPICIOUS_DOMAIN_PARTS)
            | F.rlike(domain, F.lit("[0-9]{4}")))),
        ("suspicious_links", 0.15, F.col(v.bad_link)),
        ("personal_info_request", 0.35, T.more_than(v.lower, V.PERSONAL_INFO_PHRASES, 1)),
        ("poor_grammar_quality", 0.1,
         ~T.longer_than(F.col(v.lower), 299) & T.contains_any(v.lower, V.SHORT_BAIT_PHRASES)),
    ]


# --- toxicity -------------------------------------------------------------------

_INSULTS = ["stupid", "idiots", "worthless", "trash", "scum"]


def _group(lower: str, patterns: list[str], needs: list[list[str]]) -> Column:
    return T.any_of([T.matches(lower, p, n) for p, n in zip(patterns, needs, strict=True)])


def _toxicity_rules(v: ChunkView, caps: bool = False) -> Rules:
    low = v.lower
    rules = [
        ("profanity", 0.15, _group(low, V.PROFANITY_PATTERNS, [
            ["*", "damn", "hell"], ["*"]])),
        ("hate_speech", 0.4, _group(low, V.HATE_PATTERNS, [
            _INSULTS, ["deserve ", "should "], [" inferior", " superior"]])),
        ("harassment", 0.35, _group(low, V.HARASSMENT_PATTERNS, [
            ["kill yourself", "kys", "off yourself"], ["you should ", "you deserve "],
            ["no one ", "nobody "]])),
        ("threats", 0.4, _group(low, V.THREAT_PATTERNS, [
            ["i will ", "i'll ", "i'm going to "], ["you will ", "you'll "],
            ["watch out", "be careful", "i'm coming for"]])),
    ]
    if caps:
        # Counted on the text as written; off by default, where the rule never fires.
        text = F.col(v.text)
        words = F.greatest(F.size(F.split(text, " ")), F.lit(1))
        runs = F.regexp_count(text, F.lit("[A-Z]{3,}"))
        rules.append(("excessive_caps", 0.1, (runs / words > 0.1) & T.longer_than(text, 100)))
    rules.append(("personal_attacks", 0.2, _group(low, V.ATTACK_PATTERNS, [
        ["idiot", "moron", "stupid", "dumb", "fool"], ["shut up", "go away", "get lost", "k off"]])))
    return rules


_CATEGORIES = ["profanity", "hate_speech", "harassment", "threats"]


def _toxicity_explanation(score: Column, flags: Column, hits: dict) -> Column:
    active = T.present([(hits[c], c.replace("_", " ")) for c in _CATEGORIES])
    tail = F.when(F.size(active) > 0, F.concat(F.lit("Categories: "), F.array_join(active, ", "), F.lit(".")))
    return _banded(V.TOXICITY_EXPLANATIONS, flags, score, F.coalesce(tail, F.lit("")))


def _toxicity_metadata(hits: dict) -> Column:
    pairs = [c for k in _CATEGORIES for c in (F.lit(k), F.when(hits[k], "1").otherwise("0"))]
    return F.create_map(*pairs)


def toxicity_scorer(caps: bool = False) -> Scorer:
    return Scorer(
        "defuseRagebait", "toxicity", lambda v: _toxicity_rules(v, caps),
        _fixed(V.TOXICITY_CONFIDENCE), _toxicity_explanation, _toxicity_metadata,
    )


# --- bias ---------------------------------------------------------------------

def _bias_rules(v: ChunkView) -> Rules:
    left = T.count_phrases(v.lower, V.LEFT_PHRASES)
    right = T.count_phrases(v.lower, V.RIGHT_PHRASES)
    return [
        ("left_leaning_language", 0.2, left > right * 2),
        ("right_leaning_language", 0.2, right > left * 2),
        ("loaded_language", 0.15, T.more_than(v.lower, V.LOADED_PHRASES, 3)),
        ("one_sided_argument", 0.1, T.longer_than(F.col(v.lower), 500) & ~T.contains_any(v.lower, V.BALANCE_PHRASES)),
        ("excessive_emotional_language", 0.15, T.more_than(v.lower, V.EMOTIONAL_PHRASES, 5)),
    ]


def _direction(hits: dict, left: str, right: str) -> Column:
    return (
        F.when(hits["left_leaning_language"], left)
        .when(hits["right_leaning_language"], right)
        .otherwise("neutral")
    )


def _bias_explanation(score: Column, flags: Column, hits: dict) -> Column:
    low, mid, high = V.BIAS_EXPLANATIONS
    parts = lambda t: F.concat(
        F.lit(t[0]), _direction(hits, "left-leaning", "right-leaning"), F.lit(t[1]),
        F.array_join(flags, ", "), F.lit(t[2]),
    )
    return F.when(score < 0.2, low).when(score < 0.5, parts(mid)).otherwise(parts(high))


# --- clickbait ------------------------------------------------------------------

_CLICKBAIT_NEEDS = {
    "you_wont_believe": ["you won"],
    "one_weird_trick": ["one weird trick"],
    "the_one_thing": ["the one thing you"],
    "what_happens_next": ["what happened next", "what happens next"],
    "authority_hate": ["doctors hate", "experts hate"],
    "shock_promise": ["will shock", "will blow your mind", "will amaze"],
    "heres_why": ["this is why", "why you"],
    "listicle_tease": ["reasons", "ways", "things", "secrets", "tips"],
    "viral_tease": ["gone wrong", "goes viral", "you need to see"],
}


def _clickbait_rules(v: ChunkView) -> Rules:
    rules = []
    for flag, weight, pattern in V.CLICKBAIT_PATTERNS:
        if flag == "question_headline":
            hit = F.endswith(v.both, F.lit("?"))
        else:
            hit = T.matches(v.both, pattern, _CLICKBAIT_NEEDS[flag])
        rules.append((flag, weight, hit))
    return rules


def _clickbait_bonus(v: ChunkView, hits: dict) -> list[tuple[float, Column]]:
    vague = T.matches(v.lower_title, V.VAGUE_TITLE_PATTERN, ["this", "these", "that"])
    return [(0.1, T.any_of(list(hits.values())) & vague & ~T.longer_than(F.col(v.title), 79))]


def _clickbait_explanation(score: Column, flags: Column, hits: dict) -> Column:
    named = F.array_join(F.array_remove(flags, "clickbait"), ", ")
    return F.when(
        score >= V.CLICKBAIT_THRESHOLD,
        F.concat(F.lit("Clickbait patterns: "), F.coalesce(T.nullif_blank(named), F.lit("sensational framing")),
                 F.lit(".")),
    ).otherwise("Headline appears reasonably descriptive.")


register_scorer(Scorer(
    "biasDetector", "bias", _bias_rules, _fixed(V.BIAS_CONFIDENCE), _bias_explanation,
    lambda hits: F.create_map(F.lit("biasDirection"), _direction(hits, "left", "right")),
))
register_scorer(Scorer(
    "antiManipulation", "scams", _manipulation_rules, _fixed(V.MANIPULATION_CONFIDENCE),
    lambda score, flags, hits: _banded(V.MANIPULATION_EXPLANATIONS, flags, score),
))
register_scorer(toxicity_scorer())
register_scorer(Scorer(
    "clickUnbait", "clickbait", _clickbait_rules,
    lambda score, flags: F.when(F.size(flags) > 0, 0.65).otherwise(0.5),
    _clickbait_explanation,
    extra_flags=lambda score: [(f"{score} >= {V.CLICKBAIT_THRESHOLD}D", "clickbait")],
    bonus=_clickbait_bonus,
))


# --- machine-written text (not part of the default modules) ----------------------

def _ai_rules(v: ChunkView) -> Rules:
    text = F.col(v.text)
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: T.utf16_length(T.js_trim(s)) > 10)
    n = F.size(sentences)
    openers = F.transform(
        sentences, lambda s: F.lower(F.regexp_extract(T.js_trim(s), r"(?s)^(.*?)(?:" + T.SPACE_CLASS + r"|\z)", 1))
    )
    repetition = F.lit(1.0) - F.size(F.array_distinct(openers)) / n
    generic = T.count_phrases(v.lower, V.GENERIC_PHRASES)
    word = lambda w: T.matches(v.lower, "{b}" + w + "{b}", [w])
    transitions = sum((word(w).cast("int") for w in V.TRANSITION_WORDS), F.lit(0))
    long_text = T.longer_than(text, 500)
    return [
        ("repetitive_structure", 0.2, F.when(n > 3, repetition > 0.4).otherwise(False)),
        ("generic_language", 0.15, (n > 5) & (generic > n * F.lit(0.3))),
        ("lack_of_personal_voice", 0.1, long_text & ~T.any_of([word(p) for p in V.PERSONAL_PRONOUNS])),
        ("overly_perfect_grammar", 0.1,
         (generic > 3) & T.longer_than(text, 300) & ~T.contains_any(v.lower, V.COMMON_TYPOS)),
        ("excessive_transitions", 0.15, (n > 5) & (transitions > n * F.lit(0.2))),
        ("lack_of_specific_details", 0.1,
         long_text & ~T.any_of([F.rlike(text, F.lit(p)) for p in V.SPECIFIC_DETAIL_PATTERNS])),
    ]


AI_GENERATED = Scorer(
    "aiGenerated", "accuracy", _ai_rules, _fixed(0.55),
    lambda score, flags, hits: F.array_join(flags, ", "),
)


# --- application ------------------------------------------------------------------

SCORE_FIELDS = ["module", "aspect", "problem_score", "confidence", "flags", "explanation", "metadata"]


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def with_scores(
    chunks: DataFrame,
    modules: list[str | Scorer] | None = None,
    into: str = "scores",
) -> DataFrame:
    """Add array column `into` with one struct per module; nothing is shuffled.

    Reads columns text, title, domain and links; absent ones count as empty.

    With a strict scorer among the modules, the structs get a field `error`. Where
    one of its conditions is null, error names the first such rule, and score,
    confidence, explanation and metadata are null and flags empty; roll-ups leave
    such rows out. Rules of other scorers count as not met where they are null.
    """
    wanted = list(SCORERS) if modules is None else modules
    scorers = [m if isinstance(m, Scorer) else SCORERS[m] for m in wanted]
    keep = chunks.columns
    empty = F.lit("")
    prepared = chunks.select(
        *keep,
        _column(chunks, "text", empty).alias("_text"),
        F.lower(_column(chunks, "text", empty)).alias("_lower"),
        _column(chunks, "title", empty).alias("_title"),
        F.lower(_column(chunks, "title", empty)).alias("_lower_title"),
        _column(chunks, "domain", empty).alias("_domain"),
        # The one lambda; here, so that the rules below stay in whole-stage codegen.
        (_bad_link(F.col("links")) if "links" in chunks.columns else F.lit(False)).alias("_bad_link"),
    ).withColumn("_both", F.concat("_lower_title", F.lit(" "), "_lower"))
    view = ChunkView()

    conditions, names = [], {}
    for s in scorers:
        for flag, weight, cond in s.rules(view):
            name = f"_{s.module}_{flag}"
            conditions.append((cond if s.strict else F.coalesce(cond, F.lit(False))).alias(name))
            names.setdefault(s.module, []).append((flag, weight, name))
    hit = prepared.select("*", *conditions)

    scored = []
    for s in scorers:
        # 0 + w1 + w2 + ... over the rules that hold, always added in this order.
        terms = [f"if({name}, {w}D, 0D)" for _, w, name in names[s.module]]
        total = F.expr(f"0D + {' + '.join(terms)}")
        hits = {flag: F.col(name) for flag, _, name in names[s.module]}
        for weight, cond in s.bonus(view, hits):
            total = total + F.when(cond, weight).otherwise(0.0)
        total = F.least(total, F.lit(1.0))
        if s.strict:
            failed = [F.when(F.col(name).isNull(), F.lit(f"{flag}: no result")) for flag, _, name in names[s.module]]
            scored.append(F.coalesce(*failed).alias(f"_{s.module}_error"))
            total = F.when(F.expr(" and ".join(f"{name} is not null" for _, _, name in names[s.module])), total)
        scored.append(total.alias(f"_{s.module}_score"))
    totals = hit.select("*", *scored)

    flags = []
    for s in scorers:
        own = [f"if({name}, '{flag}', '')" for flag, _, name in names[s.module]]
        own += [f"if({cond}, '{flag}', '')" for cond, flag in s.extra_flags(f"_{s.module}_score")]
        # array_remove rather than a lambda filter keeps the projection in codegen.
        own = f"array_remove(array({', '.join(own)}), '')"
        if s.strict:
            own = f"if(_{s.module}_error is null, {own}, cast(array() as array<string>))"
        flags.append(F.expr(own).alias(f"_{s.module}_flags"))
    flagged = totals.select("*", *flags)

    structs, errors = [], any(s.strict for s in scorers)
    for s in scorers:
        score, flags = F.col(f"_{s.module}_score"), F.col(f"_{s.module}_flags")
        hits = {flag: F.col(name) for flag, _, name in names[s.module]}
        error = F.col(f"_{s.module}_error") if s.strict else F.lit(None).cast("string")
        worked = (lambda c: F.when(error.isNull(), c)) if s.strict else (lambda c: c)
        structs.append(F.struct(
            F.lit(s.module).alias("module"),
            F.lit(s.aspect).alias("aspect"),
            score.alias("problem_score"),
            worked(s.confidence(score, flags)).alias("confidence"),
            flags.alias("flags"),
            worked(s.explanation(score, flags, hits)).alias("explanation"),
            worked(s.metadata(hits)).alias("metadata"),
            *([error.alias("error")] if errors else []),
        ))
    return flagged.select(*keep, F.array(*structs).alias(into))


def score_all(
    chunks: DataFrame, modules: list[str | Scorer] | None = None, key: list[str] | None = None
) -> DataFrame:
    """Long table: one row per chunk and module, with the key columns of the chunk."""
    key = key or [c for c in ("page_id", "chunk_pos", "doc_id") if c in chunks.columns]
    # The outer form, as Spark would otherwise put a "not empty" filter below the
    # projections and so evaluate every rule twice. The array is never empty.
    return with_scores(chunks, modules).select(*key, F.inline_outer("scores"))


def score(chunks: DataFrame, module: str | Scorer, key: list[str] | None = None) -> DataFrame:
    return score_all(chunks, [module], key)


def complete_scores(scores: DataFrame, key: list[str]) -> DataFrame:
    """Fill defaults: aspect by module, id, method, model, zero scores, no flags, module id."""
    have = set(scores.columns)

    def old(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    aspect = F.create_map(*[F.lit(x) for kv in V.MODULE_ASPECT.items() for x in kv])
    metadata = F.coalesce(old("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    module_id = F.create_map(F.lit("moduleId"), F.col("module"))
    return scores.select(
        *key,
        "module",
        F.coalesce(old("aspect", "string"), F.try_element_at(aspect, F.col("module")), F.lit("accuracy")).alias("aspect"),
        F.coalesce(old("id", "string"), F.concat_ws("-", "module", *key)).alias("id"),
        F.coalesce(old("method", "string"), F.col("module")).alias("method"),
        F.coalesce(old("model", "string"), F.lit("heuristic")).alias("model"),
        F.coalesce(old("problem_score", "double"), F.lit(0.0)).alias("problem_score"),
        F.coalesce(old("confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(old("flags", "array<string>"), F.array().cast("array<string>")).alias("flags"),
        old("explanation", "string").alias("explanation"),
        old("error", "string").alias("error"),
        F.map_concat(
            module_id, F.map_filter(metadata, lambda k, v: k != "moduleId")
        ).alias("metadata"),
    )


def topic(text: Column) -> Column:
    """Topics of a chunk: none for a short text, else the one topic known so far."""
    return F.when(T.longer_than(text, 99), F.array(F.lit("news"))).otherwise(
        F.array().cast("array<string>")
    )
