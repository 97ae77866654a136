"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch where the session does not say (Spark's own default is 64 MB).
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder (in folders by the values of `by`) and read it back: cuts the lineage, and survives
    lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more, and let Spark free the shuffle files of finished steps. Plans that
    still read such a table would fail, so what is returned to a caller must not."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        free(tables[0].sparkSession)


def free(spark: SparkSession) -> None:
    """Let Spark free the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


#: What operators remember in this worker from task to task; results never depend on it.
_memories: list[dict] = []


def memory() -> dict:
    """A dict for an operator's module to remember things in, used by functions of the module itself: Spark copies globals that
    functions inside others name, so such a copy would end with its task."""
    _memories.append({})
    return _memories[-1]


def alone(own: dict) -> None:
    """Let a worker forget what other operators remember in it, as Spark hands workers on from one to the next, and give back
    what Arrow holds free."""
    for m in _memories:
        if m is not own:
            m.clear()
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold BATCH_BYTES unless the session names a size: a worker and its executor each hold a batch
    whole, beside what they make of it. Changes no result."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def bit_table(cells: DataFrame, size: int) -> np.ndarray:
    """Packed bits, those of `cells` (a column of that name, below size) set: size / 8 bytes, however many cells there are."""
    blocks = cells.groupBy(F.expr("cell div 32768").alias("bucket")).agg(F.expr("bitmap_construct_agg(cell % 32768)").alias("bits")).toArrow()
    out = np.zeros(max(1, size >> 15) * 4096, np.uint8)
    for bucket, bits in zip(blocks.column("bucket").to_pylist(), blocks.column("bits").to_pylist()):
        out[bucket * 4096:(bucket + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def bits_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return ((bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of one holds about `most` bytes (one text at least)."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < len(lengths):
            yield batch.slice(at)


def span_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def of_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


SPANS = "array<struct<kind:string,start:long,end:long>>"
