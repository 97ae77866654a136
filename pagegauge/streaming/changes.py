"""A table kept by a stream of changes: versioned snapshots by bucket, and the log since then."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as ST

from pagegauge.operators.store import base_states, current_items, item_fields, log_states, merge_states


@dataclass(frozen=True)
class ChangeTable:
    """Items under `path`: what store.apply_changes over the base and the whole log gives, at a cost that follows the
    changes, not the history.

    Every micro-batch leaves one mergeable state per item it names, in folders by bucket (hash of the key). Each `every`
    batches, the buckets named since the last time are merged into a new snapshot version; other buckets stay where they
    are. A batch takes effect when its manifest appears: one file, renamed into place, that names each bucket's version
    and the first batch not merged yet. Readers see the table of some manifest, never a part of a batch. A batch that is
    run again after its manifest was written changes nothing; before that it replaces what it had written. Changes may
    come in any order, across batches too, so deleted items keep their state. A key may be null; changes of equal time
    to one item are taken in no defined order. Old versions are left for readers that still use them.
    """

    path: str
    key: tuple[str, ...]
    buckets: int = 64
    every: int = 4
    seq: str = "ts"
    op: str = "op"

    def create(self, base: DataFrame, seq_type: ST.DataType) -> None:
        """Start from a table that holds each key once."""
        base.limit(0).coalesce(1).write.parquet(f"{self.path}/schema")
        self._write(self._bucketed(base_states(base, list(self.key), seq_type)), f"snapshot/version={-1}")
        every = base.sparkSession.range(self.buckets).select(F.col("id").alias("bucket"), F.lit(-1).cast("long").alias("version"))
        self._publish(every, -1, 0, self._states_ddl(base.schema, seq_type))

    def sink(self) -> Callable[[DataFrame, int], None]:
        """foreachBatch function."""
        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            through, log_from, states_ddl, versions = self._manifest(spark)
            if batch_id <= through:
                return
            base = spark.read.parquet(f"{self.path}/schema")
            key, fields = list(self.key), item_fields(base, list(self.key))
            states = merge_states(log_states(batch, base.schema, key, self.seq, self.op), key, fields)
            self._write(self._bucketed(states), f"log/batch_id={batch_id}")
            if batch_id + 1 - log_from >= self.every:
                log = self._log(spark, states_ddl, log_from, batch_id)
                named = {r.bucket for r in log.select("bucket").distinct().collect()}
                old = self._snapshot(spark, states_ddl, {b: v for b, v in versions.items() if b in named})
                both = old.unionByName(log).repartition("bucket")
                self._write(merge_states(both, ["bucket", *key], fields), f"snapshot/version={batch_id}")
                versions = {b: batch_id if b in named else v for b, v in versions.items()}
                log_from = batch_id + 1
            rows = spark.createDataFrame(sorted(versions.items()), "bucket long, version long")
            self._publish(rows, batch_id, log_from, states_ddl)
        return write

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the newest manifest."""
        through, log_from, states_ddl, versions = self._manifest(spark)
        states = self._snapshot(spark, states_ddl, versions).unionByName(self._log(spark, states_ddl, log_from, through))
        key, fields = list(self.key), item_fields(spark.read.parquet(f"{self.path}/schema"), list(self.key))
        return current_items(merge_states(states, key, fields), key, fields)

    def _bucketed(self, states: DataFrame) -> DataFrame:
        return states.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))).repartition("bucket")

    def _write(self, states: DataFrame, folder: str) -> None:
        states.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _states_ddl(self, base: ST.StructType, seq_type: ST.DataType) -> str:
        at = f"struct<r:int,t:{seq_type.simpleString()}>"
        fields = [f for f in base.names if f not in self.key and f != "updated"]
        columns = [(c, base[c].dataType.simpleString()) for c in self.key] + [("_reset", at), ("_last", "string"), ("_end", at)]
        columns += [(f, base[f].dataType.simpleString()) for f in fields] + [(f"_at_{f}", at) for f in fields]
        return ", ".join(f"`{c}` {t}" for c, t in columns) + ", bucket long"

    def _publish(self, versions: DataFrame, through: int, log_from: int, states_ddl: str) -> None:
        rows = versions.withColumn("log_from", F.lit(log_from).cast("long")).withColumn("states", F.lit(states_ddl))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/through={through}")

    def _manifest(self, spark: SparkSession) -> tuple[int, int, str, dict[int, int]]:
        """The newest manifest: one row per bucket."""
        schema = "bucket long, version long, log_from long, states string, through long"
        every = spark.read.schema(schema).parquet(f"{self.path}/manifest")
        through = every.agg(F.max("through")).first()[0]
        rows = every.where(F.col("through") == through).collect()
        return through, rows[0].log_from, rows[0].states, {r.bucket: r.version for r in rows}

    def _snapshot(self, spark: SparkSession, states_ddl: str, versions: dict[int, int]) -> DataFrame:
        found = spark.createDataFrame([], states_ddl)
        for version in sorted(set(versions.values())):
            rows = spark.read.schema(states_ddl).parquet(f"{self.path}/snapshot/version={version}")
            found = found.unionByName(rows.where(F.col("bucket").isin([b for b, v in versions.items() if v == version])))
        return found

    def _log(self, spark: SparkSession, states_ddl: str, first: int, last: int) -> DataFrame:
        paths = [f"{self.path}/log/batch_id={i}" for i in range(first, last + 1)]
        if not paths:
            return spark.createDataFrame([], states_ddl)
        rows = spark.read.option("basePath", f"{self.path}/log").schema(f"{states_ddl}, batch_id long").parquet(*paths)
        return rows.drop("batch_id")


def change_stream(changes: DataFrame, table: ChangeTable, checkpoint: str):
    """Apply what has arrived of a stream of insert, update and delete rows."""
    return (changes.writeStream.foreachBatch(table.sink()).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
