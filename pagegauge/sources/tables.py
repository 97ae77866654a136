"""Readers for the input tables, and where results of a job may be kept."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagegauge.operators.claims import REVIEWS, with_review_defaults

FACT_CHECK_JSON = (
    "text string, claimant string, claimDate string, "
    "claimReview array<struct<publisher:struct<name:string>,url:string,title:string,reviewDate:string,"
    "textualRating:string,languageCode:string>>"
)
GOLDEN_JSON = (
    "inputs struct<url:string>, outputs struct<"
    "pageMetadata:struct<url:string,title:string,domain:string,author:string,description:string,publishedTime:string>,"
    "analysisResult:struct<status:string,results:array<struct<chunkId:string,statements:array<struct<"
    "type:string,summaryText:string,analyses:array<struct<type:string,methodName:string,problemScore:double,"
    "confidence:double,flags:array<string>,explanation:string>>>>>>>>"
)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few files.

    One file with one row group is one task, however many cores there are. An
    input with at least as many files as cores is left alone, so a large table
    is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_fact_checks(spark: SparkSession, path: str) -> DataFrame:
    """Fact checks from JSON lines: fact_id, text, claimant, claim_date, reviews.

    fact_id is a hash of the record, so it does not depend on how files are split.
    """
    raw = spark.read.schema(FACT_CHECK_JSON).json(path)
    review = F.transform("claimReview", lambda r: F.struct(
        r["publisher"]["name"].alias("publisher"), r["url"].alias("url"), r["title"].alias("title"),
        r["reviewDate"].alias("review_date"), r["textualRating"].alias("textual_rating"),
        r["languageCode"].alias("language_code")))
    rows = raw.select(
        F.xxhash64(F.to_json(F.struct("*"))).alias("fact_id"), "text", "claimant",
        F.col("claimDate").alias("claim_date"), review.cast(REVIEWS).alias("reviews"))
    return with_review_defaults(rows)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Recorded analyses (nested JSON documents): one row per chunk, statement and analysis."""
    raw = spark.read.schema(GOLDEN_JSON).option("multiLine", True).json(path)
    results = raw.select(
        F.coalesce("outputs.pageMetadata.url", "inputs.url").alias("url"), "outputs.pageMetadata.domain",
        "outputs.pageMetadata.title", "outputs.analysisResult.status",
        F.explode_outer("outputs.analysisResult.results").alias("r"))
    statements = results.select(
        "url", "domain", "title", "status", F.col("r.chunkId").alias("chunk_id"),
        F.posexplode_outer("r.statements").alias("statement_pos", "s"))
    analyses = statements.select(
        "url", "domain", "title", "status", "chunk_id", "statement_pos",
        F.col("s.type").alias("statement_type"), F.col("s.summaryText").alias("statement"),
        F.explode_outer("s.analyses").alias("a"))
    return analyses.select(
        *analyses.columns[:-1], F.col("a.type").alias("aspect"), F.col("a.methodName").alias("method"),
        F.col("a.problemScore").alias("problem_score"), F.col("a.confidence").alias("confidence"),
        F.col("a.flags").alias("flags"), F.col("a.explanation").alias("explanation"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a job's results and stream checkpoints, in the shared folder
    that the cluster names in spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder is used."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        return tempfile.mkdtemp(prefix=f"{name}-")
    unique = spark.sql("SELECT uuid()").first()[0]
    return f"{shared.rstrip('/')}/{name}-{unique}"
