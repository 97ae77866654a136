"""Roll scores up to chunks, to pages per module, and to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegauge import fixed_values as V
from pagegauge.functions import text as T

_MODULE_ORDER = list(V.MODULE_ASPECT)


def module_order(module: Column) -> Column:
    """Place of a module in the report order; unknown modules come last."""
    places = F.create_map(*[F.lit(x) for i, m in enumerate(_MODULE_ORDER) for x in (m, i)])
    return F.coalesce(F.try_element_at(places, module), F.lit(len(_MODULE_ORDER)))


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 0.8, "very-high").when(score >= 0.6, "high").when(score >= 0.4, "medium")
        .when(score >= 0.2, "low").when(score > 0, "very-low").otherwise("unknown")
    )


def display_band(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.6, "medium").otherwise("high")


def traffic_light(score: Column) -> Column:
    return F.when(score >= 0.7, "High Risk").when(score >= 0.4, "Caution").otherwise("Safe")


def verdict(score: Column) -> Column:
    """Page verdict; unlike the bands above, the limits themselves are still the milder one."""
    return F.when(score > 0.7, "high-risk").when(score > 0.4, "caution").otherwise("safe")


def _mean(items: Column, field: str) -> Column:
    """Mean of a field over an array, added up in array order; 0 if empty."""
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x[field])
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0)


def summary_of(scores: Column) -> Column:
    """Chunk summary of an array of score structs in module order (no shuffle).

    Structs need aspect, problem_score, confidence and flags; rows with an error
    must be left out beforehand.
    """
    def build(valid: Column) -> Column:
        flag = F.transform(valid, lambda a: F.struct(
            a["aspect"].alias("type"),
            risk_band(a["problem_score"]).alias("risk_rating"),
            F.coalesce(F.get(a["flags"], F.lit(0)), a["aspect"]).alias("label"),
        ))
        return F.struct(
            _mean(valid, "problem_score").alias("problem_score"),
            _mean(valid, "confidence").alias("confidence"),
            flag.alias("flags"),
        )
    return build(scores)


def with_summary_text(df: DataFrame, score: str = "problem_score") -> DataFrame:
    risk = risk_band(F.col(score))
    S = V.SUMMARY_TEXTS
    text = F.when(F.col("overall_risk").isin("very-high", "high"), S["high"]).when(
        F.col("overall_risk") == "medium", S["medium"]
    ).otherwise(S["low"])
    return df.withColumn("overall_risk", risk).withColumn("summary_text", text)


def _valid(scores: DataFrame) -> Column:
    return F.col("error").isNull() if "error" in scores.columns else F.lit(True)


def summarize_chunks(scores: DataFrame, key: list[str]) -> DataFrame:
    """One row per chunk from the long score table: mean score and confidence of
    the rows without error, risk, one flag per aspect, summary text.

    A chunk has at most one row per module, so the collected list is short.
    """
    item = F.struct(
        module_order(F.col("module")).alias("place"), "module", "aspect", "problem_score", "confidence", "flags"
    )
    grouped = scores.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(_valid(scores), item))).alias("valid")
    )
    summary = grouped.select(*key, summary_of(F.col("valid")).alias("s")).select(*key, "s.*")
    return with_summary_text(summary)


def summarize_chunk_arrays(chunks: DataFrame, key: list[str], scores: str = "scores") -> DataFrame:
    """The same summary for chunks that still hold their scores as an array: no shuffle."""
    items = F.col(scores)
    if "error" in chunks.schema[scores].dataType.elementType.names:
        items = F.filter(items, lambda a: a["error"].isNull())
    summary = chunks.select(*key, summary_of(items).alias("s")).select(*key, "s.*")
    return with_summary_text(summary)


def chunk_problem_score(summary_score: Column, scores: Column) -> Column:
    """Summary score if there is one, else the mean of the scores."""
    return F.coalesce(summary_score, _mean(scores, "problem_score"))


def neutralised(score: Column) -> Column:
    return F.coalesce(score >= V.NEUTRALISED_THRESHOLD, F.lit(False))


def summarize_page_modules(scores: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """One row per page and module: mean score, distinct flags in order of first
    appearance, explanation and metadata of the first chunk.

    Two steps, both with partial sums before their shuffle: first per page,
    module and flag, then per page and module. A page with very many chunks is
    reduced on the map side, and a list holds distinct flags only.
    """
    # A null entry stands for the score row itself, the others for its flags.
    marks = F.concat(
        F.array(F.lit(None).cast("string")), F.coalesce("flags", F.array().cast("array<string>"))
    )
    rows = scores.where(_valid(scores)).select(
        *page, "module", "problem_score", "explanation", "metadata",
        F.struct(*order).alias("at"), F.posexplode_outer(marks).alias("flag_pos", "flag"),
    )
    is_row = F.col("flag").isNull()
    by_flag = rows.groupBy(*page, "module", "flag").agg(
        F.sum(F.when(is_row, F.col("problem_score"))).alias("total"),
        F.count(F.when(is_row, 1)).alias("n"),
        F.min(F.struct("at", "flag_pos")).alias("first_at"),
        F.min_by(F.when(is_row, F.struct("explanation", "metadata")), "at").alias("first"),
    )
    ordered = F.sort_array(F.collect_list(
        F.when(F.col("flag").isNotNull(), F.struct("first_at", "flag"))
    ))
    return by_flag.groupBy(*page, "module").agg(
        (F.sum("total") / F.sum("n")).alias("problem_score"),
        F.transform(ordered, lambda x: x["flag"]).alias("flags"),
        F.first("first", ignorenulls=True).alias("first"),
        F.sum("n").alias("n_chunks"),
    ).select(
        *page, "module", "problem_score", F.lit(V.PAGE_MODULE_CONFIDENCE).alias("confidence"),
        "flags", "first.explanation", "first.metadata", "n_chunks",
    )


def summarize_pages(page_modules: DataFrame, page: list[str]) -> DataFrame:
    """Page verdict: mean of the module means, added in module order."""
    items = F.sort_array(F.collect_list(F.struct(
        module_order(F.col("module")).alias("place"), "module",
        F.coalesce("problem_score", F.lit(0.0)).alias("problem_score"),
    )))
    grouped = page_modules.groupBy(*page).agg(items.alias("items"))
    scored = grouped.select(*page, _mean(F.col("items"), "problem_score").alias("score"))
    return scored.withColumn("overall", verdict(F.col("score")))


def neutralised_per_page(chunk_summaries: DataFrame, page: list[str]) -> DataFrame:
    return chunk_summaries.groupBy(*page).agg(
        F.count_if(neutralised(F.col("problem_score"))).alias("neutralised"),
        F.count("*").alias("n_chunks"),
    )


def nutrition_label(scores: DataFrame, key: list[str]) -> DataFrame:
    """Per chunk: label, mean score, distinct flags in module order, worst module
    (the first of equals). A chunk with errors only has the label 'No Data'."""
    item = F.struct(module_order(F.col("module")).alias("place"), "module", "problem_score", "flags")
    usable = _valid(scores) & F.col("problem_score").isNotNull()
    grouped = scores.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(usable, item))).alias("items"))
    items = F.col("items")
    worst = F.array_max(F.transform(items, lambda x: F.struct(
        x["problem_score"].alias("problem_score"), (-x["place"]).alias("rank"), x["module"].alias("module"))))
    some = F.size(items) > 0
    score = _mean(items, "problem_score")
    return grouped.select(
        *key,
        F.when(some, traffic_light(score)).otherwise("No Data").alias("label"),
        score.alias("score"),
        F.array_distinct(F.flatten(F.transform(items, lambda x: x["flags"]))).alias("flags"),
        worst["module"].alias("highest_module"),
        worst["problem_score"].alias("highest_score"),
    )


def result_table(page_modules: DataFrame, page: list[str]) -> DataFrame:
    """Display rows per page and module."""
    score = F.coalesce("problem_score", F.lit(0.0))
    return page_modules.select(
        *page, "module",
        # The small allowance makes halves go up, whatever order the mean was added in.
        F.round(score * 100 + 1e-9, 0).cast("int").alias("score_percent"),
        F.round(F.coalesce("confidence", F.lit(0.0)) * 100, 0).cast("int").alias("confidence_percent"),
        display_band(score).alias("band"),
    )


def safe_percent(page_score: Column) -> Column:
    return F.round((F.lit(1.0) - F.coalesce(page_score, F.lit(0.0))) * 100 + 1e-9, 1)


def ads_hidden(live: Column, analysed: Column) -> Column:
    return F.greatest(F.coalesce(live, F.lit(0)), F.coalesce(analysed, F.lit(0)))


def page_status(pages: DataFrame, label: str = "Page check") -> DataFrame:
    """Status line of each page.

    Reads status (or derives it from site_enabled, error and n_chunks),
    neutralised, ads_hidden, overall and progress; absent columns count as empty.
    """
    have = set(pages.columns)

    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    derived = (
        F.when(~col("site_enabled", True), "excluded")
        .when(col("error", "") != "", "error")
        .when(col("n_chunks", 0) == 0, "no_chunks")
        .otherwise("completed")
    )
    status = F.when(~col("site_enabled", True), F.lit("excluded")).otherwise(
        F.coalesce(F.col("status"), derived) if "status" in have else derived
    )
    base = pages.withColumns({
        "status": status,
        "neutralised": col("neutralised", 0),
        "ads_hidden": col("ads_hidden", 0),
    }).withColumn("flagged", F.col("neutralised") + F.col("ads_hidden"))
    parts = F.concat_ws(
        ", ",
        F.when(F.col("neutralised") > 0, F.concat(F.col("neutralised").cast("string"), F.lit(" labelled"))),
        F.when(F.col("ads_hidden") > 0, F.concat(F.col("ads_hidden").cast("string"), F.lit(" ads hidden"))),
    )
    st = F.col("status")
    return base.withColumns({
        "badge": F.when(st == "error", "!").when(st == "analyzing", "…")
        .when(st == "completed", T.format_count(F.col("flagged"))).otherwise(""),
        "color": F.when(st == "error", "red").when(st == "analyzing", "blue")
        .when(st == "completed", F.when(col("overall", "safe") == "high-risk", "red")
              .when(col("overall", "safe") == "caution", "orange").otherwise("green")).otherwise("grey"),
        "line": F.when(st == "excluded", f"{label} is off for this site")
        .when(st == "error", f"{label}: analysis failed")
        .when(st == "no_chunks", f"{label}: no content to analyze")
        .when(st == "analyzing", F.concat(F.lit(f"{label}: analyzing page ("), col("progress", 0).cast("string"), F.lit("%)")))
        .when(st == "completed", F.when(F.col("flagged") > 0, F.concat(F.lit(f"{label}: "), parts, F.lit(" on this page")))
              .otherwise(f"{label}: analysis complete, nothing flagged"))
        .otherwise(label),
    })
