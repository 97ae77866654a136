"""The whole path from pages to verdicts.

`analyze` composes the operators lazily. `run_analysis` is the job for large
inputs: it writes each table once and reads it back, so that chunks are cut and
scored once although several results use them, and a lost executor costs tasks
of one stage only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagegauge.operators import rollup as R
from pagegauge.operators.chunks import blocked_count, partition_ads
from pagegauge.operators.claims import score_accuracy
from pagegauge.operators.extract import extract_chunks
from pagegauge.operators.scorers import complete_scores, with_scores
from pagegauge.operators.settings import Settings, enabled_modules

KEY = ["page_id", "chunk_pos"]
SCORE_COLUMNS = ["module", "aspect", "problem_score", "confidence", "flags", "explanation", "metadata"]


@dataclass(frozen=True)
class Analysis:
    """chunks hold content only; ads hold the adverts taken out of the pages."""

    chunks: DataFrame
    ads: DataFrame
    scores: DataFrame
    chunk_summaries: DataFrame
    page_modules: DataFrame
    pages: DataFrame


def gate_pages(pages: DataFrame, settings: Settings | None) -> DataFrame:
    """Add the modules that run on each page. Done before any markup is read."""
    if settings is None:
        from pagegauge.fixed_values import MODULE_ASPECT
        return pages.withColumn("modules", F.array(*[F.lit(m) for m in MODULE_ASPECT]))
    return enabled_modules(pages, settings)


def cut_pages(pages: DataFrame, settings: Settings | None, include_ads: bool = True) -> DataFrame:
    """Chunks of the pages where some module runs."""
    gated = gate_pages(pages, settings).where(F.size("modules") > 0)
    return extract_chunks(gated, include_ads=include_ads, carry=["modules"])


def score_chunks(chunks: DataFrame, fact_checks: DataFrame | None) -> DataFrame:
    """Long score table of the modules that run on each chunk's page."""
    allowed = F.filter("scores", lambda s: F.array_contains(F.col("modules"), s["module"]))
    rules = with_scores(chunks).withColumn("scores", allowed).select(*KEY, F.explode_outer("scores").alias("s")).where(
        "s is not null").select(*KEY, "s.*")
    checked = chunks.where(F.array_contains("modules", "factChecker"))
    return complete_scores(rules.unionByName(score_accuracy(checked, fact_checks, KEY)), KEY)


def page_results(pages: DataFrame, chunks: DataFrame, ads: DataFrame, summaries: DataFrame, modules: DataFrame,
                 settings: Settings | None) -> DataFrame:
    """One row per page, also for excluded pages and pages without chunks."""
    gated = gate_pages(pages.select("page_id", "url"), settings).select(
        "page_id", "url", (F.size("modules") > 0).alias("site_enabled"))
    verdicts = R.summarize_pages(modules, ["page_id"])
    counts = R.neutralised_per_page(summaries, ["page_id"])
    joined = gated.join(verdicts, "page_id", "left").join(counts, "page_id", "left").join(
        blocked_count(ads, ["page_id"]), "page_id", "left")
    return R.page_status(joined)


def analyze(pages: DataFrame, settings: Settings | None = None, fact_checks: DataFrame | None = None) -> Analysis:
    chunks, ads = partition_ads(cut_pages(pages, settings))
    scores = score_chunks(chunks, fact_checks)
    summaries = R.summarize_chunks(scores, KEY)
    modules = R.summarize_page_modules(scores, ["page_id"], ["chunk_pos"])
    return Analysis(chunks, ads, scores, summaries, modules,
                    page_results(pages, chunks, ads, summaries, modules, settings))


def run_analysis(
    pages: DataFrame, out: str, settings: Settings | None = None, fact_checks: DataFrame | None = None
) -> Analysis:
    """Write chunks, ads, scores, summaries and page results below `out`."""
    spark = pages.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    cut = keep(cut_pages(pages, settings), "cut")
    chunks, ads = partition_ads(cut)
    scores = keep(score_chunks(chunks, fact_checks), "scores")
    summaries = keep(R.summarize_chunks(scores, KEY), "chunk_summaries")
    modules = keep(R.summarize_page_modules(scores, ["page_id"], ["chunk_pos"]), "page_modules")
    results = keep(page_results(pages, chunks, ads, summaries, modules, settings), "pages")
    return Analysis(chunks, ads, scores, summaries, modules, results)


def rescore_new(chunks: DataFrame, scores: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Chunks that have no score rows yet."""
    key = key or KEY
    return chunks.join(scores.select(*key).distinct(), key, "left_anti")
