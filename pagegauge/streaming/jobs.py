"""Structured Streaming jobs. Each function takes streaming DataFrames; the same
operators as in batch do the work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pagegauge.fixed_values import NEUTRALISED_THRESHOLD
from pagegauge.operators.chunks import partition_ads
from pagegauge.operators.extract import extract_chunks
from pagegauge.operators.feedback import ingest_feedback, reject_reason, resolve_feedback
from pagegauge.operators.scorers import with_scores
from pagegauge.operators.settings import bundle_site_rules, current_bundle


def analyze_stream(pages: DataFrame) -> DataFrame:
    """Pages to scores, row by row and without state: (page_id, chunk_pos, module, ...)."""
    content, _ = partition_ads(extract_chunks(pages, include_ads=True))
    return with_scores(content).select("page_id", "chunk_pos", F.inline_outer("scores"))


def once_each(feedback: DataFrame, delay: str | None = None) -> DataFrame:
    """Drop rows sent again: the same feedback_id at any time, or within the delay.

    Without a delay the ledger of ids is the state of the stream: partitioned by the
    hash of the id, asked only for the ids of a batch, compacted and restored by
    Spark. It keeps every id, so run such a stream with RocksDB state
    (spark.sql.streaming.stateStore.providerClass), which holds it on disk. No row is
    too late. With a delay, ids are forgotten and late rows are dropped.
    """
    if delay is None:
        return feedback.dropDuplicates(["feedback_id"])
    return feedback.withWatermark("created", delay).dropDuplicatesWithinWatermark(["feedback_id"])


def checked_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with the reason for its rejection, null if accepted."""
    return feedback.withColumn("reject_reason", reject_reason())


def feedback_sink(chunks: Callable[[], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: accepted, rejected and stub rows of each batch.

    Every batch writes its own folders and overwrites them when it is run again,
    so a restart neither loses nor doubles rows. `chunks` is read anew per batch.
    A fingerprint gets one stub, in the first batch that names it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            accepted, rejected = ingest_feedback(batch)
            linked, stubs = resolve_feedback(accepted, chunks())
            stored = stored_stubs(batch.sparkSession, out, batch_id)
            if stored is not None:
                stubs = stubs.join(stored, "fingerprint", "left_anti").select(*stubs.columns)
            for name, rows in (("accepted", linked), ("rejected", rejected), ("stubs", stubs)):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()
    return write


def stored_stubs(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """Fingerprints with a stub from a batch before this one; None if no batch has written yet."""
    try:
        stubs = spark.read.option("basePath", f"{out}/stubs").parquet(f"{out}/stubs")
    except AnalysisException:
        return None
    return stubs.where(F.col("batch_id") < before).select("fingerprint").distinct()


def newest_rows(states: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows that an update stream has written batch by batch, the newest of each key."""
    rows = [c for c in states.columns if c != "batch_id"]
    return states.groupBy(*key).agg(F.max_by(F.struct(*rows), "batch_id").alias("_row")).select("_row.*")


def feedback_stream(
    feedback: DataFrame, chunks: Callable[[], DataFrame], out: str, checkpoint: str, delay: str | None = None
) -> StreamingQuery:
    """Validate, link and store feedback from a stream; each feedback_id once (see once_each)."""
    return (
        once_each(feedback, delay).writeStream.foreachBatch(feedback_sink(chunks, out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def new_ads_stream(ads: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Adverts seen for the first time: one row per page and root within the delay."""
    return ads.withWatermark(time, delay).dropDuplicatesWithinWatermark(["page_id", "ad_root"])


def feedback_tally_stream(feedback: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Votes per window, chunk and aspect; in a window a user's latest vote counts.

    Rows appear when the watermark passes the end of their window. Votes are first
    reduced per user, so one busy chunk is spread over its users.
    """
    voter = F.coalesce(F.col("user_id"), F.concat(F.lit("#"), F.col("feedback_id").cast("string")))
    latest = feedback.withWatermark("created", delay).groupBy(
        F.window("created", window), "chunk_fingerprint", "aspect_type", voter.alias("voter")
    ).agg(
        F.max_by("applies", F.struct("created", "feedback_id")).alias("applies"), F.count("*").alias("n_events")
    )
    return latest.groupBy("window", "chunk_fingerprint", "aspect_type").agg(
        F.count_if(F.col("applies")).alias("applies"),
        F.count_if(~F.col("applies")).alias("applies_not"),
        F.sum("n_events").alias("n_events"),
    ).select(F.col("window.start").alias("window_start"), "chunk_fingerprint", "aspect_type",
             "applies", "applies_not", "n_events")


def with_config(read_bundles: Callable[[], DataFrame], bundle_id: str,
                use: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that hands every batch the newest config rules."""
    def run(batch: DataFrame, batch_id: int) -> None:
        use(batch, bundle_site_rules(current_bundle(read_bundles(), bundle_id)), batch_id)
    return run


# --- per-page state ------------------------------------------------------------

PAGE_SUMMARY = ("page_id long, batch long, newest timestamp, loaded boolean, since timestamp, completed boolean, "
                "neutralised long, n_updates long")
PAGE_STATE = "page_id long, status string, neutralised long, n_updates long, since timestamp"
KEPT_STATE = "status string, neutralised long, n_updates long, since timestamp, batch long, until long"
KEEP_MS = 60_000
# A page without a completion is forgotten a day after its newest event.
IDLE_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_summaries(events: DataFrame) -> DataFrame:
    """What the events of a batch do to each page, as one row: only aggregates by page, so no page's events are
    gathered, however many they are.

    A load starts a page anew, so events before the newest load have no effect; nor have those after the first
    completion that follows. Events of equal time go by event_id.
    """
    timed = events.select("page_id", "kind", "score", F.struct("ts", "event_id").alias("at"))
    starts = timed.groupBy("page_id").agg(
        F.max("at.ts").alias("newest"), F.max(F.when(F.col("kind") == "load", F.col("at"))).alias("start"))
    same = F.col("e.page_id").eqNullSafe(F.col("s.page_id"))
    live = timed.alias("e").join(starts.alias("s"), same).where("s.start IS NULL OR e.at >= s.start").select("e.*", "newest", "start")
    stops = live.groupBy("page_id").agg(F.min(F.when(F.col("kind") == "complete", F.col("at"))).alias("stop"))
    counted = (F.col("kind") == "update") & (F.col("t.stop").isNull() | (F.col("e.at") < F.col("t.stop")))
    return live.alias("e").join(stops.alias("t"), F.col("e.page_id").eqNullSafe(F.col("t.page_id"))).groupBy("e.page_id").agg(
        F.max("newest").alias("newest"), F.max("start.ts").alias("since"), F.max("t.stop").isNotNull().alias("completed"),
        F.count_if(counted & (F.col("score") >= NEUTRALISED_THRESHOLD)).alias("neutralised"),
        F.count_if(counted).alias("n_updates")).withColumn("loaded", F.col("since").isNotNull())


def page_summary_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Summaries of every micro-batch under `out`, for page_state_stream. Events: page_id, event_id, ts, kind (load,
    update, complete), score. A batch that is run again replaces its folder."""
    order = [f.split()[0] for f in PAGE_SUMMARY.split(", ")]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = page_summaries(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.select(*order).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")

    return (events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_summaries(spark: SparkSession, out: str) -> DataFrame:
    """The summaries under `out` as a stream."""
    return spark.readStream.schema(PAGE_SUMMARY).parquet(f"{out}/batch-*")


class PageState(StatefulProcessor):
    """Folds summaries of a page into its state; a timer frees the state."""

    def __init__(self, keep_ms: int, idle_ms: int) -> None:
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", KEPT_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        status, hits, updates, since, batch, until = self.page.get() if self.page.exists() else ("idle", 0, 0, None, -1, None)
        newest = None
        # One row per micro-batch of events; one that was folded already came again.
        for r in sorted(rows, key=lambda r: r.batch):
            if r.batch <= batch:
                continue
            batch, newest = r.batch, r.newest if newest is None else max(newest, r.newest)
            if r.loaded:
                status, hits, updates, since = "analyzing", 0, 0, r.since
            elif status == "completed":
                continue
            hits, updates = hits + r.neutralised, updates + r.n_updates
            if r.completed:
                status = "completed"
        if newest is None:
            return
        if until is not None:
            self.handle.deleteTimer(until)
        keep = self.keep_ms if status == "completed" else self.idle_ms
        until = max(int(newest.timestamp() * 1000) + keep, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(until)
        self.page.update((status, hits, updates, since, batch, until))
        yield Row(page_id=key[0], status=status, neutralised=hits, n_updates=updates, since=since)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.page.clear()
        return iter(())

    def close(self) -> None:
        pass


def page_state_stream(summaries: DataFrame, delay: str = "10 minutes", keep_ms: int = KEEP_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Status of each page: a load starts it anew, updates count the chunks at or above the threshold, completion ends
    it. Batches count in their order. The state is freed by a timer in event time: keep_ms after the newest event of a
    completed page, idle_ms after that of any other. A summary is late when the newest event in it is.

    One row comes out per page and micro-batch. Needs RocksDB state: run_available(..., rocksdb=True).
    """
    return summaries.withWatermark("newest", delay).groupBy("page_id").transformWithState(
        PageState(keep_ms, idle_ms), PAGE_STATE, "update", "eventtime")


# --- running -----------------------------------------------------------------------

def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Process what is there, write it as parquet and read it back. With `rocksdb` this query's state is held there,
    whatever the session names for others."""
    spark: SparkSession = stream.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    if rocksdb:
        spark.conf.set(setting, ROCKSDB)
    try:
        if mode == "append":
            query = (
                stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
        else:
            def write(batch: DataFrame, batch_id: int) -> None:
                batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            query = (
                stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .outputMode(mode).trigger(availableNow=True).start())
    finally:
        if rocksdb and before is None:
            spark.conf.unset(setting)
        elif rocksdb:
            spark.conf.set(setting, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)
