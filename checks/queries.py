"""The checked queries in Spark: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import inputs as I
from pagegauge.operators import rollup as R, scorers as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HEURISTIC = ["biasDetector", "antiManipulation", "defuseRagebait", "clickUnbait"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(col: str, sep: str = ", ") -> F.Column:
    return F.array_join(col, sep)


# --- scorers --------------------------------------------------------------------

@query
def bias_by_source(spark, sf):
    scored = S.score(I.chunks(spark, sf), "biasDetector", ["doc_id", "source"])
    return scored.withColumn("risk", R.risk_band(F.col("problem_score"))).groupBy("source", "risk").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg("problem_score") + 1e-10, 6).alias("mean_score"))


def _module(spark, sf, module):
    return S.score(I.chunks(spark, sf), module, ["doc_id"]).select(
        "doc_id", F.round("problem_score", 6).alias("problem_score"), "confidence",
        joined("flags").alias("flags"), "explanation")


@query
def bias_scores(spark, sf):
    return _module(spark, sf, "biasDetector")


@query
def manipulation_scores(spark, sf):
    return _module(spark, sf, "antiManipulation")


@query
def toxicity_scores(spark, sf):
    return _module(spark, sf, "defuseRagebait")


@query
def clickbait_scores(spark, sf):
    return _module(spark, sf, "clickUnbait")


@query
def aspect_long(spark, sf):
    scores = S.complete_scores(S.score_all(I.chunks(spark, sf), HEURISTIC, ["doc_id"]), ["doc_id"])
    return scores.select(
        "doc_id", "module", "aspect", "id", "method", "model", F.round("problem_score", 6).alias("problem_score"),
        "confidence", joined("flags").alias("flags"), "explanation", "error",
        F.col("metadata")["moduleId"].alias("module_id"))


def _long(spark, sf):
    return S.score_all(I.chunks(spark, sf), HEURISTIC, ["doc_id", "source"])


# --- roll-ups ---------------------------------------------------------------------

@query
def chunk_summary(spark, sf):
    scored = S.with_scores(I.chunks(spark, sf), HEURISTIC)
    # Scores come in registration order, which is the report order of these modules.
    return R.summarize_chunk_arrays(scored, ["doc_id"]).select(
        "doc_id", F.round(F.col("problem_score") + 1e-10, 6).alias("problem_score"),
        F.round("confidence", 6).alias("confidence"), "overall_risk", "summary_text",
        F.array_join(F.transform("flags", lambda f: f["label"]), "|").alias("labels"),
        F.array_join(F.transform("flags", lambda f: f["risk_rating"]), "|").alias("ratings"),
        F.array_join(F.transform("flags", lambda f: f["type"]), "|").alias("types"))


@query
def nutrition_label(spark, sf):
    return R.nutrition_label(_long(spark, sf), ["doc_id"]).select(
        "doc_id", "label", F.round("score", 6).alias("score"), joined("flags").alias("flags"),
        "highest_module", F.round("highest_score", 6).alias("highest_score"))


def _page_modules(spark, sf):
    return R.summarize_page_modules(_long(spark, sf), ["source"], ["doc_id"])


@query
def page_module_rollup(spark, sf):
    return _page_modules(spark, sf).select(
        "source", "module", F.round(F.col("problem_score") + 1e-10, 6).alias("problem_score"), "confidence",
        joined("flags").alias("flags"), "explanation", "n_chunks")


@query
def page_verdict(spark, sf):
    pages = R.summarize_pages(_page_modules(spark, sf), ["source"])
    scored = S.with_scores(I.chunks(spark, sf), HEURISTIC)
    counts = R.neutralised_per_page(R.summarize_chunk_arrays(scored, ["doc_id", "source"]), ["source"])
    return pages.join(counts, "source").select(
        "source", F.round(F.col("score") + 1e-10, 6).alias("score"), "overall", R.safe_percent(F.col("score")).alias("safe_percent"),
        "neutralised", "n_chunks")


@query
def result_table(spark, sf):
    return R.result_table(_page_modules(spark, sf), ["source"])


@query
def display_bands(spark, sf):
    from pagegauge.operators.chunks import with_preview
    chunks = I.chunks(spark, sf)
    summaries = R.summarize_chunk_arrays(S.with_scores(chunks, HEURISTIC), ["doc_id"])
    return with_preview(summaries, chunks, ["doc_id"]).select(
        "doc_id", R.display_band(F.col("problem_score")).alias("band"),
        R.neutralised(F.col("problem_score")).alias("neutralised"), "text_preview")


@query
def toxicity_vs_labels(spark, sf):
    scored = S.score(I.chunks(spark, sf), "defuseRagebait", ["doc_id"]).select(
        "doc_id", R.risk_band(F.col("problem_score")).alias("risk"))
    return scored.join(I.table(spark, sf, "labels"), "doc_id").groupBy("risk", "toxic", "quality").agg(
        F.count("*").alias("n"))
