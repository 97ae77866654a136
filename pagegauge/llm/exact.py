"""Exact dedup in two passes with a Bloom filter.

The first pass counts, for every cell of a Bloom filter, the rows that fall on it; what several rows fall on is a set bit. The
second pass looks every row up: a row with a cell of its own has no copy anywhere and passes straight through, without a
shuffle. Only the rest, copies and a few others, is written, grouped by digest and joined with its groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, bits_set, saved, slices, small_batches, with_fields

#: Cells of a row, cells made for each row of the table, and cells at least and at most (2^29 bits are 64 MB to send). A
#: filter that is too small for its table lets more rows through to the exact grouping, and changes no result.
CELLS, CELLS_A_ROW, FEWEST, MOST = 3, 16, 1 << 16, 1 << 29
#: Cells that a task counts at once before it reports them.
RUN = 1_000_000
ADDED = ("text_sha256", "keep_id", "group_size", "kept")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal_texts(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text, A-Z lower-cased; of null, none. One translation for the whole column."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = memoryview((column.buffers()[2] or pa.py_buffer(b"")).to_pybytes().translate(_LOWER))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def cells_of(texts: list[memoryview], size: int) -> np.ndarray:
    """The cells of each text (a row each): size is a power of two."""
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), ">u8").astype(np.uint64).reshape(-1, 2)
    steps = np.arange(CELLS, dtype=np.uint64)
    return ((digests[:, :1] + steps * (digests[:, 1:] | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)


def filter_size(rows: int) -> int:
    return min(MOST, max(FEWEST, 1 << (rows * CELLS_A_ROW - 1).bit_length() if rows else FEWEST))


def repeated_cells(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """The filter: a bit for every cell that several rows fall on, packed, of size / 8 bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def report() -> pa.RecordBatch:
            own, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.minimum(many, 2).astype(np.int32))], names=["cell", "n"])

        for batch in slices(batches, text):
            if not batch.num_rows:
                continue
            # Two cells of one row may be one: it falls on that once.
            rows = np.sort(cells_of(list(normal_texts(batch.column(text))), size), axis=1)
            held.append(rows[np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1)])
            n += len(held[-1])
            if n >= RUN:
                yield report()
                held, n = [], 0
        if held:
            yield report()

    cells = docs.select(text).mapInArrow(count, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    return bit_table(cells, size)


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Every row of docs with text_sha256 (of the normalised text), keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and very long texts are read whole. Of equal
    texts the row with the largest doc_id is kept: keep_id is that id (null if all are null) and group_size counts the rows. Of
    rows that repeat this id with the same text one is kept. An empty table gives an empty one. Columns of docs with the added
    names are replaced; `columns` are those of docs that are returned (all unless given).

    Rows without a copy pass straight through the second pass. Of the others only the digest, the id and the returned columns
    are written and shuffled; the groups are made by partial aggregation and joined by digest, so a group of any size is
    counted before it moves, and Spark may split a large one's rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in columns or docs.columns if c not in ADDED]
    size = filter_size(docs.count())
    # What the operator reads is named apart from the columns that it hands on.
    rows = docs.select(F.struct(*own).alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(repeated_cells(rows, "text", size))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in slices(batches, "text"):
            texts = list(normal_texts(batch.column("text")))
            if not texts:
                continue
            cells = cells_of(texts, size)
            repeated = bits_set(bits, cells).all(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(repeated)],
                names=["row", "id", "text_sha256", "repeated"])

    looked = rows.mapInArrow(look_up, with_fields(rows.select("row", "id"), "text_sha256 string, repeated boolean"))
    alone = looked.where("not repeated").select(
        "row.*", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = saved(looked.where("repeated").drop("repeated").withColumn("place", F.monotonically_increasing_id()), "repeated")
    groups = saved(some.groupBy("text_sha256").agg(
        F.max(F.struct("id", "place")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = some.join(groups, "text_sha256").select(
        "row.*", "text_sha256", F.col("best.id").alias("keep_id"), "group_size", (F.col("place") == F.col("best.place")).alias("kept"))
    return alone.unionByName(found)
