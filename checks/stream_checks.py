"""Checked streaming queries: files are read as a stream to their end, the result is
written as a table, and the table is what the query returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.oracle import SQL, lit
from checks.page_checks import ARTICLE_TEXT
from checks.oracle import BASE, RULES, u16  # noqa: F401
from checks.queries import query
from checks.table_checks import FB, OKAY, REASON, _KNOWN, _known_chunks, change_tables
from pagegauge import fixed_values as V
from pagegauge.operators.settings import shipped_rules  # noqa: F401
from pagegauge.sources.tables import work_dir
from pagegauge.streaming import jobs as J
from pagegauge.streaming.changes import ChangeTable, change_stream


def stream(spark, sf, name):
    schema = I.table(spark, sf, name).schema
    # A pattern names one file as well as a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def finish(spark, df, name, mode="append"):
    base = work_dir(spark, name)
    return J.run_available(df, f"{base}/out", f"{base}/checkpoint", mode)


@query
def stream_scores(spark, sf):
    scores = J.analyze_stream(stream(spark, sf, "pages"))
    return finish(spark, scores, "stream_scores").select(
        "page_id", "chunk_pos", "module", F.round("problem_score", 6).alias("problem_score"), F.array_join("flags", ", ").alias("flags"))


_AD = " OR ".join(f"contains(lower(text), {lit(w)})" for w in V.AD_TEXT_WORDS)
_BIAS = RULES["biasDetector"]
SQL["stream_scores"] = f"""WITH p AS (SELECT page_id, {ARTICLE_TEXT} AS text FROM pages), b AS (SELECT page_id, text, lower(text) AS l FROM p
      WHERE {u16('text')} >= 100 AND NOT ({_AD})), s AS (SELECT *, {' + '.join(f'(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)' for _, w, c in _BIAS)} AS v FROM b)
    SELECT page_id, 0 AS chunk_pos, 'biasDetector' AS module, round(v, 6) AS problem_score,
      concat_ws(', ', {', '.join(f'CASE WHEN {c} THEN {lit(f)} END' for f, _, c in _BIAS)}) AS flags FROM s
    UNION ALL SELECT page_id, 0, 'antiManipulation', 0::DOUBLE, '' FROM b
    UNION ALL SELECT page_id, 0, 'defuseRagebait', CASE WHEN t THEN 0.15::DOUBLE ELSE 0::DOUBLE END, CASE WHEN t THEN 'profanity' ELSE '' END
      FROM (SELECT page_id, {RULES['defuseRagebait'][0][2]} AS t FROM b)
    UNION ALL SELECT page_id, 0, 'clickUnbait', CASE WHEN q THEN 0.15::DOUBLE ELSE 0::DOUBLE END, CASE WHEN q THEN 'question_headline' ELSE '' END
      FROM (SELECT page_id, l LIKE '%?' AS q FROM b)"""


@query
def stream_feedback(spark, sf):
    """Feedback from the event files, sent twice: each row counts once."""
    events = stream(spark, sf, "events")
    base = work_dir(spark, "stream_feedback")
    once = I.feedback_of(spark, events)
    again = I.feedback_of(spark, stream(spark, sf, "events"))
    job = J.feedback_stream(once.unionByName(again), lambda: _known_chunks(spark, sf), base, f"{base}/checkpoint")
    job.awaitTermination()
    read = spark.read.option("basePath", f"{base}/accepted").parquet(f"{base}/accepted")
    rejected = spark.read.option("basePath", f"{base}/rejected").parquet(f"{base}/rejected")
    return read.select("feedback_id", "chunk_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rejected.select("feedback_id", F.lit(None).cast("long").alias("chunk_id"), "reject_reason"))


SQL["stream_feedback"] = f"""WITH k AS (SELECT fingerprint, min(chunk_id) AS chunk_id FROM ({_KNOWN}) GROUP BY 1)
    SELECT feedback_id, CASE WHEN {REASON} IS NULL THEN k.chunk_id END AS chunk_id, {REASON} AS reject_reason
    FROM ({FB}) LEFT JOIN k ON chunk_fingerprint = fingerprint"""


RESENT = 1_000_000_000_000


@query
def stream_resend(spark, sf):
    """All feedback in three batches, then after a restart all of it again, a week later, beside as much new feedback."""
    base = work_dir(spark, "stream_resend")
    first = I.feedback(spark, sf)
    later = first.withColumn("created", F.col("created") + F.expr("interval 7 days"))
    fresh = later.withColumn("feedback_id", F.col("feedback_id") + RESENT)
    # A batch is many files, as many tasks write and read it: a multiple of both numbers of batches.
    tasks = 6 * -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 6)
    files = 0

    def run(rows, batches):
        nonlocal files
        rows.repartition(tasks, "feedback_id").write.mode("append").parquet(f"{base}/in")
        written = len(spark.read.parquet(f"{base}/in").inputFiles())
        source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", max(1, -(-(written - files) // batches))).parquet(f"{base}/in")
        J.feedback_stream(source, lambda: _known_chunks(spark, sf), f"{base}/out", f"{base}/checkpoint").awaitTermination()
        files = written

    run(first, 3)
    run(later.unionByName(fresh), 2)
    read = lambda name: spark.read.option("basePath", f"{base}/out/{name}").parquet(f"{base}/out/{name}").select(
        "feedback_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), F.lit(name).alias("outcome"))
    return read("accepted").unionByName(read("rejected"))


SQL["stream_resend"] = f"""WITH f AS (SELECT * FROM ({FB}) UNION ALL
      SELECT * REPLACE (feedback_id + {RESENT} AS feedback_id, created + INTERVAL 7 DAY AS created) FROM ({FB}))
    SELECT feedback_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created,
      CASE WHEN {REASON} IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome FROM f"""


@query
def stream_feedback_tally(spark, sf):
    """Daily votes; a day is reported once the newest event is an hour past it."""
    ok = J.checked_feedback(I.feedback_of(spark, stream(spark, sf, "events"))).where("reject_reason is null")
    tally = finish(spark, J.feedback_tally_stream(ok), "stream_feedback_tally")
    return tally.withColumn("window_start", F.date_format(F.col("window_start"), "yyyy-MM-dd"))


SQL["stream_feedback_tally"] = f"""WITH {OKAY}, v AS (SELECT date_trunc('day', created) AS d, chunk_fingerprint, aspect_type,
      coalesce(user_id, concat('#', feedback_id)) AS voter, arg_max(applies, (created, feedback_id)) AS applies, count(*) AS n FROM ok GROUP BY 1, 2, 3, 4)
    SELECT strftime(d, '%Y-%m-%d') AS window_start, chunk_fingerprint, aspect_type, count(*) FILTER (applies) AS applies,
      count(*) FILTER (NOT applies) AS applies_not, sum(n)::BIGINT AS n_events FROM v
    WHERE d + INTERVAL 1 DAY <= (SELECT max(created) - INTERVAL 1 HOUR FROM ok) GROUP BY 1, 2, 3"""


@query
def stream_new_ads(spark, sf):
    """Repeated sightings of the same advert on a page are reported once."""
    seen = stream(spark, sf, "events").select(
        F.col("user_id").alias("page_id"), F.concat(F.lit("/html/body/div["), F.get_json_object("props", "$.k"), F.lit("]")).alias("ad_root"),
        F.col("ts").cast("timestamp").alias("ts"))
    return finish(spark, J.new_ads_stream(seen, delay="60 days"), "stream_new_ads").select("page_id", "ad_root")


SQL["stream_new_ads"] = "SELECT DISTINCT user_id AS page_id, concat('/html/body/div[', props->>'$.k', ']') AS ad_root FROM events"


@query
def stream_page_state(spark, sf):
    """Views load a page, purchases complete it, other events are score updates; in three batches, one third of the time
    each, with a restart before each. No state is freed in that time."""
    kind = F.when(F.col("event_type") == "view", "load").when(F.col("event_type") == "purchase", "complete").otherwise("update")
    events = I.table(spark, sf, "events").select(
        F.col("user_id").alias("page_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"),
        (F.col("value") / 50).alias("score"))
    base = work_dir(spark, "stream_page_state")
    first, last = events.select(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(first)) * 3 / F.lit(last - first + 1))
    for i in range(3):
        events.where(part == i).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        J.page_summary_stream(source, f"{base}/summaries", f"{base}/checkpoint").awaitTermination()
        states = J.page_state_stream(J.read_summaries(spark, f"{base}/summaries"), keep_ms=10 ** 12, idle_ms=10 ** 12)
        found = J.run_available(states, f"{base}/states", f"{base}/states_checkpoint", "update", rocksdb=True)
    return J.newest_rows(found, ["page_id"]).select(
        "page_id", "status", "neutralised", "n_updates", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


SQL["stream_page_state"] = """WITH e AS (SELECT user_id AS page_id, event_id, ts, event_type, value / 50 AS score FROM events),
    l AS (SELECT page_id, max((ts, event_id)) AS start FROM e WHERE event_type = 'view' GROUP BY page_id),
    a AS (SELECT e.*, l.start FROM e LEFT JOIN l ON e.page_id = l.page_id WHERE l.start IS NULL OR (e.ts, e.event_id) >= l.start),
    c AS (SELECT page_id, min((ts, event_id)) AS stop FROM a WHERE event_type = 'purchase' GROUP BY page_id)
    SELECT a.page_id, CASE WHEN any_value(c.stop) IS NOT NULL THEN 'completed' WHEN any_value(start) IS NOT NULL THEN 'analyzing' ELSE 'idle' END AS status,
      count(*) FILTER (event_type NOT IN ('view', 'purchase') AND score >= 0.4 AND (stop IS NULL OR (ts, event_id) < stop)) AS neutralised,
      count(*) FILTER (event_type NOT IN ('view', 'purchase') AND (stop IS NULL OR (ts, event_id) < stop)) AS n_updates,
      strftime(max(ts) FILTER (event_type = 'view'), '%Y-%m-%d %H:%M:%S') AS since
    FROM a LEFT JOIN c ON a.page_id = c.page_id GROUP BY a.page_id"""


@query
def stream_config(spark, sf):
    """Each batch of pages meets the newest version of the site rules."""
    base = work_dir(spark, "stream_config")

    def bundles():
        data = F.create_map(F.lit("gov.uk"), F.create_map(F.lit("factChecker"), F.col("r_regionkey") % 2 == 1))
        return I.table(spark, sf, "region").select(
            F.lit("domain-off-defaults").alias("bundle_id"), F.col("r_regionkey").alias("version"),
            F.col("r_regionkey").alias("updated_at"), F.lit("remote").alias("source"), data.alias("data"))

    def use(batch, rules, batch_id):
        from pagegauge.operators.settings import off_by_default
        site = F.when(F.col("page_id") % 2 == 0, "https://www.gov.uk/a").otherwise(F.col("url"))
        gated = off_by_default(batch.select("page_id", site.alias("url")), rules, "factChecker")
        gated.select("page_id", "off_by_default").write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    job = stream(spark, sf, "pages").writeStream.foreachBatch(J.with_config(bundles, "domain-off-defaults", use)).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id", "off_by_default")


SQL["stream_config"] = "SELECT page_id, page_id % 2 = 0 AS off_by_default FROM pages"


@query
def stream_changes(spark, sf):
    """Orders change stored customers, in four batches that hold all times each and are merged by twos, then a batch that took
    effect is handed over again."""
    base, log = change_tables(spark, sf)
    home = work_dir(spark, "stream_changes")
    table = ChangeTable(f"{home}/table", ("id",), buckets=8, every=2)
    table.create(base, log.schema["ts"].dataType)
    log.repartition(4, "ts").write.parquet(f"{home}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    change_stream(source, table, f"{home}/checkpoint").awaitTermination()
    table.sink()(log, 0)
    return table.read(spark)


SQL["stream_changes"] = SQL["apply_changes"]
