"""Scores from a language or zero-shot model: prompts out, replies in.

The model itself is the user's: either a table of replies, or a function that is
loaded once per Python worker and fed batches of prompts (`model_replies`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T
from pagegauge.operators.scorers import SCORERS, _banded, with_scores

# Short instructions in our own words; pass another text to build_prompts to replace one.
SYSTEM_PROMPTS = {
    "biasDetector": "Judge the text below for political bias and one-sidedness.",
    "antiManipulation": "Judge the text below for scams, fraud and pressure tactics.",
    "defuseRagebait": "Judge the text below for hateful, threatening or abusive language.",
    "clickUnbait": "Judge the headline and text below for clickbait.",
}
REPLY_FORMAT = "Answer with a JSON object with the fields score (0 to 1), confidence (0 to 1), flags and explanation."


def _known(df: DataFrame, name: str) -> Column:
    col = F.col(name) if name in df.columns else F.lit(None).cast("string")
    return T.nullif_blank(col.cast("string"))


def build_prompts(
    chunks: DataFrame, module: str, key: list[str], system_prompt: str | None = None, style: str = "server",
    max_links: int | None = None,
) -> DataFrame:
    """key, system, prompt. Style "server" names every field and writes N/A for a
    missing one; style "local" leaves missing fields out, and lists max_links links (None: all)."""
    system = system_prompt or f"{SYSTEM_PROMPTS[module]} {REPLY_FORMAT}"
    fields = {"URL": "url", "Domain": "domain", "Title": "title"}
    if module == "biasDetector":
        fields["Author"] = "author"
    text = F.coalesce(F.col("text"), F.lit(""))
    has_links = "links" in chunks.columns
    urls = F.transform("links", lambda x: x["url"]) if has_links else None
    lines = []
    for label, name in fields.items():
        value = _known(chunks, name)
        if style == "server":
            value = F.coalesce(value, F.lit("N/A"))
        lines.append(F.concat(F.lit(f"{label}: "), value))
    if style == "local" and module == "antiManipulation" and has_links:
        listed = urls if max_links is None else F.slice(urls, 1, max_links)
        lines.append(F.when(F.size(urls) > 0, F.concat(F.lit("Links: "), F.array_join(listed, ", "))))
    body = F.concat_ws("\n", *lines, F.lit(""), F.lit("Content:"), text)
    if style == "server" and module == "antiManipulation":
        listed = T.nullif_blank(F.array_join(urls, "\n")) if has_links else F.lit(None).cast("string")
        body = F.concat(body, F.lit("\n\nLinks found:\n"), F.coalesce(listed, F.lit("None")))
    return chunks.select(*key, F.lit(system).alias("system"), body.alias("prompt"))


def model_text(text: Column, max_chars: int | None = None) -> Column:
    """Text as handed to a zero-shot model: max_chars characters of it (None: all)."""
    whole = F.coalesce(text, F.lit(""))
    return whole if max_chars is None else T.truncate(whole, max_chars)


def model_replies(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], key: list[str]) -> DataFrame:
    """Run the user's model over the prompts: key, reply, error.

    load() is called once per Python worker and returns a function from a list of
    prompts to a list of replies. Where it fails on a batch, each prompt is tried by
    itself, so that only the prompts that fail get an error.
    """
    none = F.lit(None).cast("string")
    schema = prompts.select(*key, none.alias("reply"), none.alias("error")).schema

    def run(batches: Iterator) -> Iterator:
        model = load()

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return model([prompt])[0], None
            except Exception as problem:  # noqa: BLE001 - becomes a row, the scores fall back
                return None, str(problem)

        for batch in batches:
            out = batch[key].copy()
            try:
                out["reply"], out["error"] = model(batch["prompt"].tolist()), None
            except Exception:  # noqa: BLE001 - each prompt's own error becomes a row
                tried = [one(p) for p in batch["prompt"]]
                out["reply"], out["error"] = [r for r, _ in tried], [e for _, e in tried]
            yield out

    return prompts.select(*key, "prompt").mapInPandas(run, schema)


# --- zero-shot ----------------------------------------------------------------

def zero_shot_score(labels: Column, scores: Column, candidates: Column) -> Column:
    """Score of the risk label (the first candidate), else 1 - score of the safe one, else 0.5."""
    def score_of(label: Column) -> Column:
        place = F.array_position(labels, label)
        return F.when(place > 0, F.coalesce(F.get(scores, (place - 1).cast("int")), F.lit(0.0)))
    risk = score_of(F.get(candidates, F.lit(0)))
    safe = score_of(T.nullif_blank(F.get(candidates, F.lit(1))))
    return F.coalesce(T.clamp01(risk), T.clamp01(F.lit(1.0) - safe), F.lit(0.5))


def zero_shot_confidence(scores: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.coalesce(F.get(scores, F.lit(0)), F.lit(0.7))))


def score_zero_shot(df: DataFrame, module: str, key: list[str]) -> DataFrame:
    """Result rows from columns labels, scores and candidate_labels."""
    scored = df.select(
        *key,
        zero_shot_score(F.col("labels"), F.col("scores"), F.col("candidate_labels")).alias("problem_score"),
        zero_shot_confidence(F.col("scores")).alias("confidence"),
    )
    flags, explanation = _zero_shot_flags(module, F.col("problem_score"))
    return scored.withColumn("flags", flags).withColumn("explanation", explanation)


def _zero_shot_flags(module: str, score: Column) -> tuple[Column, Column]:
    if module == "clickUnbait":
        bait = score >= V.CLICKBAIT_THRESHOLD
        return T.present([(bait, "clickbait")]), F.when(
            bait, "Headline looks like clickbait (withholding or sensational framing)."
        ).otherwise("Headline appears straightforward.")
    flags = T.present([(score > 0.45, "local_zero_shot")])
    if module == "biasDetector":
        low, mid, high = V.BIAS_EXPLANATIONS
        joined = F.array_join(flags, ", ")
        say = lambda t: F.concat(F.lit(t[0] + "neutral" + t[1]), joined, F.lit(t[2]))
        return flags, F.when(score < 0.2, low).when(score < 0.5, say(mid)).otherwise(say(high))
    texts = V.MANIPULATION_EXPLANATIONS if module == "antiManipulation" else V.TOXICITY_EXPLANATIONS
    return flags, _banded(texts, flags, score)


# --- replies --------------------------------------------------------------------

def parse_model_replies(replies: DataFrame, module: str, key: list[str], reply: str = "reply", max_explanation: int | None = None) -> DataFrame:
    """Scores from reply texts: the JSON object in the reply, zero-shot or not; else
    a "score: x" figure; else the module's default. A plain reply is its own explanation,
    max_explanation characters of it (None: all)."""
    parsed = replies.withColumn("_json", F.try_parse_json(T.first_json_object(F.col(reply))))
    get = lambda name, kind: F.try_variant_get("_json", f"$.{name}", kind)
    fields = parsed.select(
        *key, F.col(reply).alias("_reply"), F.col("_json").isNotNull().alias("_has_json"),
        get("labels", "array<string>").alias("_labels"),
        get("scores", "array<double>").alias("_scores"),
        get("candidateLabels", "array<string>").alias("_candidates"),
        F.coalesce(get("problemScore", "double"), get("score", "double"), F.lit(0.0)).alias("_score"),
        get("confidence", "double").alias("_confidence"),
        get("flags", "array<string>").alias("_flags"),
        get("explanation", "string").alias("_explanation"),
        get("biasDirection", "string").alias("_direction"),
    )
    figure = F.regexp_extract("_reply", "(?i)score[:" + T.SPACE_CLASS[1:-1] + r"]+([0-9.]+)", 1)
    number = F.regexp_extract(figure, r"^([0-9]*\.?[0-9]*)", 1).try_cast("double")
    zero = F.col("_labels").isNotNull() & (F.size("_candidates") > 0)
    kinds = fields.withColumn(
        "_kind", F.when(F.col("_has_json") & F.coalesce(zero, F.lit(False)), "zero").when(F.col("_has_json"), "json").otherwise("text")
    ).withColumn(
        "_raw", F.when(figure == "", F.lit(V.REPLY_DEFAULT_SCORE[module])).otherwise(F.coalesce(number, F.lit(0.0)))
    )
    kind = F.col("_kind")
    score = (
        F.when(kind == "zero", zero_shot_score(F.col("_labels"), F.col("_scores"), F.col("_candidates")))
        .when(kind == "json", T.clamp01(F.col("_score"))).otherwise(T.clamp01(F.col("_raw")))
    )
    given = F.when(F.col("_confidence") != 0, F.col("_confidence"))
    confidence = (
        F.when(kind == "zero", zero_shot_confidence(F.col("_scores")))
        .when(kind == "json", T.clamp01(F.coalesce(given, F.lit(0.7)))).otherwise(0.5)
    )
    scored = kinds.withColumn("problem_score", score).withColumn("confidence", confidence)
    zero_flags, zero_text = _zero_shot_flags(module, F.col("problem_score"))
    own = F.coalesce("_flags", F.array().cast("array<string>"))
    text_flags = F.array().cast("array<string>")
    if module == "clickUnbait":
        own = F.when(F.col("problem_score") >= V.CLICKBAIT_THRESHOLD, F.array_union(own, F.array(F.lit("clickbait")))).otherwise(own)
        text_flags = T.present([(F.col("_raw") >= V.CLICKBAIT_THRESHOLD, "clickbait")])
    plain = F.col("_reply") if max_explanation is None else F.substring("_reply", 1, max_explanation)
    said = F.coalesce(T.nullif_blank(F.col("_explanation")), F.lit("Analysis completed"))
    metadata = F.lit(None).cast("map<string,string>")
    if module == "biasDetector":
        way = F.when(kind == "json", F.coalesce(T.nullif_blank(F.col("_direction")), F.lit("neutral"))).otherwise("neutral")
        metadata = F.create_map(F.lit("biasDirection"), way)
    return scored.select(
        *key, F.lit(module).alias("module"), F.lit(V.MODULE_ASPECT[module]).alias("aspect"),
        "problem_score", "confidence",
        F.when(kind == "zero", zero_flags).when(kind == "json", own).otherwise(text_flags).alias("flags"),
        F.when(kind == "zero", zero_text).when(kind == "json", said).otherwise(plain).alias("explanation"),
        metadata.alias("metadata"),
    )


def score_with_fallback(
    chunks: DataFrame, replies: DataFrame, module: str, key: list[str], model: str = "model"
) -> DataFrame:
    """Model reply where it is usable, the module's rules otherwise, and which it was.

    replies: key, reply[, error]. No reply row counts as "no backend"; an error or
    an empty reply is kept in the metadata of the rule-based row.
    """
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    usable = error.isNull() & (T.js_trim(F.coalesce(F.col("reply"), F.lit(""))) != "")
    good = parse_model_replies(replies.where(usable).withColumn("reply", T.js_trim(F.col("reply"))), module, key)
    fields = ["problem_score", "confidence", "flags", "explanation", "metadata"]
    model_side = good.select(*key, F.struct(*fields).alias("_m"), F.lit(None).cast("string").alias("_error"))
    bad_side = replies.where(~usable).select(
        *key, F.lit(None).cast(model_side.schema["_m"].dataType).alias("_m"),
        F.coalesce(error, F.lit("Empty generation")).alias("_error"),
    )
    heuristic = with_scores(chunks, [SCORERS[module]], "_h").select(*key, F.get("_h", F.lit(0)).alias("_h"))
    joined = heuristic.join(model_side.unionByName(bad_side), key, "left")
    none = F.create_map().cast("map<string,string>")
    merge = lambda meta, *kv: F.map_concat(F.coalesce(meta, none), F.create_map(*kv))
    is_model = F.col("_m").isNotNull()
    metadata = (
        F.when(is_model, merge(F.col("_m.metadata"), F.lit("localModel"), F.lit(model)))
        .when(F.col("_error").isNotNull(), merge(F.col("_h.metadata"), F.lit("localModelError"), F.col("_error")))
        .otherwise(merge(F.col("_h.metadata"), F.lit("localModelSkipped"), F.lit("no_backend")))
    )
    return joined.select(
        *key, F.lit(module).alias("module"), F.lit(V.MODULE_ASPECT[module]).alias("aspect"),
        F.when(is_model, model).otherwise("heuristic").alias("model"),
        *[F.when(is_model, F.col(f"_m.{f}")).otherwise(F.col(f"_h.{f}")).alias(f) for f in fields[:-1]],
        metadata.alias("metadata"),
    )
