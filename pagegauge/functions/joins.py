"""Joins and picks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def default_salts(df: DataFrame) -> int:
    """One task in 32 for a hot key, at least 8 and at most 64 tasks."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(64, partitions // 32))


#: Counters in a task's sketch of frequent keys, at least.
TRACKED = 10_000


def hot_keys(keys: DataFrame, on: list[str]) -> DataFrame:
    """Hashes (`key_hash`) of the keys that own more rows than an even share of a
    shuffle task: as many as there are shuffle tasks, at most.

    One pass over the key columns: each task fills a sketch of frequent items of
    fixed size, and the sketches meet in one row. Where the sketch names a key too
    many or too few, that costs balance and never a row.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(1_000_000, max(TRACKED, 16 * tasks))
    top = F.call_function("approx_top_k", F.xxhash64(*on), F.lit(min(tasks, tracked)), F.lit(tracked))
    found = keys.agg(top.alias("top"), F.count(F.lit(1)).alias("n")).select("n", F.explode("top").alias("t"))
    return found.where(F.col("t.count") * tasks > F.col("n")).select(F.col("t.item").alias("key_hash"))


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", salts: int | None = None, sketch: bool = False
) -> DataFrame:
    """Equi-join whose left rows of one key spread over `salts` tasks.

    With `sketch`, only the hot keys of the left side are spread, and only their
    right rows are repeated; the keys of the left side are read once more for it
    (see hot_keys). Otherwise, and for streams, all keys are spread.

    `right` should be narrow: each of its rows, or with `sketch` each row of a hot
    key, is repeated `salts` times. If
    Spark's own size estimate lets it broadcast the right side, no row of the
    left side moves at all; otherwise a hot key is split instead of filling
    one task, and adaptive execution splits what is still too large.  Only
    inner, left, left_semi and left_anti joins are possible this way, as every
    salt must see every right row.
    """
    salts = salts or default_salts(left)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot be salted on the left")
    # Structs and maps cannot all be hashed, so the salt comes from plain columns.
    plain = [f.name for f in left.schema.fields if f.dataType.typeName() in
             ("long", "integer", "string", "binary", "timestamp", "double", "date", "short")]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in plain]), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    # Equal keys of different types have different hashes.
    alike = all(left.schema[c].dataType == right.schema[c].dataType for c in on)
    if sketch and alike and not left.isStreaming:
        hot = F.broadcast(hot_keys(left.select(*on), on).withColumn("_hot", F.lit(True)))  # one row a shuffle task, at most
        marked = lambda df: df.withColumn("key_hash", F.xxhash64(*on)).join(hot, "key_hash", "left").drop("key_hash")
        spread = marked(left).withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
        copies = marked(right).withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    else:
        spread = left.withColumn("_salt", salt)
        copies = right.withColumn("_salt", F.explode(every))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark turns "row_number = 1" into a limit per input partition before the
    shuffle, so a key with very many copies sends one row per task.
    """
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, key: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows per key in the given order, limited before the shuffle as well."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Newest row per key."""
    return first_by(df, key, [F.col(order).desc()])
