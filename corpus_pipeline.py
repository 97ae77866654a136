"""A training corpus from `documents`: good texts, one of each group of near copies, without benchmark passages, without
personal data, as token ids. Each stage works on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import decontaminate, jaccard, personal, pieces, quality
from pagegauge.llm.common import saved, table

#: Near copies share so much of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows in one column beside id and text, so that no column of theirs meets one that an operator adds."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are good with a probability of a half or more; without labels, all."""
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(_rows(docs), model).where(quality.accepted()).select("row.*")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies, once; rows with a null id stay.

    Where one doc_id stands in rows of different texts, each text is judged by itself: one of them (the smallest hash)
    goes by the doc_id, the others by numbers beyond it, so they stay unless they copy another document. Rows equal in
    doc_id and text are one.
    """
    digest = F.xxhash64("text")
    again = saved(docs.where("doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(digest).alias("least")).where("n > 1").select("doc_id", "least"), "again")
    if again.isEmpty():
        node, numbered = F.col("doc_id"), docs.select("doc_id", "text", F.struct("*").alias("row"))
    else:
        other = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
        node = F.when(F.col("least").isNull() | (digest == F.col("least")), F.col("doc_id")).otherwise(other)
        rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
        numbered = rows.join(again, "doc_id", "left")
    nodes = numbered.select(node.cast("long").alias("node"), "text", "row")
    groups = saved(jaccard.jaccard_components(nodes, SHINGLE, PERCENT, doc_id="node"), "groups")
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct()
    kept = nodes.join(copies, "node", "left_anti")
    if not again.isEmpty():
        more = again.select(F.col("doc_id").alias("id"))
        many = kept.join(more, F.col("row.doc_id") == F.col("id"), "left_semi").dropDuplicates(["node"])
        kept = kept.join(more, F.col("row.doc_id") == F.col("id"), "left_anti").unionByName(many)
    return kept.select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in passages of the benchmark."""
    found = decontaminate.find_shared(_rows(docs), table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select("row.*")


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by their kinds in brackets; n_chars becomes the new length."""
    found = personal.find_personal(_rows(docs)).select("row", personal.masked("text", "spans").alias("clean"))
    row = F.col("row").withField("text", F.col("clean")).withField("n_chars", F.length("clean").cast("long"))
    return found.select(row.alias("row")).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (the end id last), decoded_sha256 of what the ids decode to."""
    encoded = pieces.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_stage),
    ("SentencePiece encoding and decoding", tokens_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage_{i}")
    return docs
