"""Streams over files that arrive one after the other, with restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F, types as ST

from pagegauge.operators import store as D
from pagegauge.streaming import jobs as J
from pagegauge.streaming.changes import ChangeTable
from pagegauge.operators.feedback import FEEDBACK_SCHEMA

T0 = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")


def source(spark, path, schema):
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENTS = "event_id long, page_id long, ts timestamp, kind string, score double"


def page_states(spark, path, **kept):
    """The newest state of each page after what has arrived under path/in."""
    J.page_summary_stream(source(spark, f"{path}/in", EVENTS), f"{path}/sums", f"{path}/cp").awaitTermination()
    states = J.page_state_stream(J.read_summaries(spark, f"{path}/sums"), **kept)
    found = J.run_available(states, f"{path}/out", f"{path}/cp2", "update", rocksdb=True)
    return {r.page_id: (r.status, r.neutralised, r.n_updates) for r in J.newest_rows(found, ["page_id"]).collect()}


def test_page_state_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, "1", [(1, 7, at(0), "load", None), (3, 7, at(2), "update", 0.1), (2, 7, at(1), "update", 0.9), (9, 8, at(0), "update", 0.5)], EVENTS)
    assert page_states(spark, tmp_path) == {7: ("analyzing", 1, 2), 8: ("idle", 1, 1)}
    # A restart goes on from the checkpoint: new events only, old state kept.
    put(spark, src, "2", [(4, 7, at(3), "update", 0.4), (5, 7, at(4), "complete", None), (6, 7, at(5), "update", 1.0)], EVENTS)
    assert page_states(spark, tmp_path)[7] == ("completed", 2, 3)
    # A reload starts over.
    put(spark, src, "3", [(7, 7, at(6), "load", None), (8, 7, at(7), "update", 0.1)], EVENTS)
    assert page_states(spark, tmp_path)[7] == ("analyzing", 0, 1)


def test_page_state_is_freed(spark, tmp_path):
    src, kept = str(tmp_path / "in"), {"keep_ms": 60_000, "idle_ms": 3_600_000}
    put(spark, src, "1", [(1, 7, at(0), "load", None), (2, 7, at(1), "complete", None), (3, 8, at(1), "update", 0.9), (4, 9, at(1), "update", 0.9)], EVENTS)
    page_states(spark, tmp_path, **kept)
    # The newest event moves the watermark past the hour of pages 8 and 9 and the minute of page 7.
    put(spark, src, "2", [(5, 1, at(200), "update", 0.1)], EVENTS)
    page_states(spark, tmp_path, **kept)
    # All begin anew, though page 7 had been completed, and page 8 had an update.
    put(spark, src, "3", [(6, 7, at(201), "update", 0.9), (7, 8, at(201), "update", 0.1)], EVENTS)
    after = page_states(spark, tmp_path, **kept)
    assert after[7] == ("idle", 1, 1) and after[8] == ("idle", 0, 1) and after[9] == ("idle", 1, 1)


def test_page_summaries_against_plain_python(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(6) or None, at(rnd.randrange(30)), rnd.choice(["load", "update", "update", "update", "complete", None]), rnd.choice([None, 0.1, 0.4, 0.9]))
            for i in range(400)]
    want = {}
    for page in {r[1] for r in rows}:
        loaded, done, hits, n = False, False, 0, 0
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (r[2], r[0])):
            if r[3] == "load":
                loaded, done, hits, n = True, False, 0, 0
            elif r[3] == "complete":
                done = True
            elif r[3] == "update" and not done:
                n, hits = n + 1, hits + (r[4] is not None and r[4] >= 0.4)
        want[page] = (loaded, done, hits, n)
    got = J.page_summaries(spark.createDataFrame(rows, EVENTS)).collect()
    assert {r.page_id: (r.loaded, r.completed, r.neutralised, r.n_updates) for r in got} == want
    assert J.page_summaries(spark.createDataFrame([], EVENTS)).count() == 0


CHANGES = "id long, op string, ts long, name string, n int"


def test_changes_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    base = spark.createDataFrame([(i, f"b{i}", i) for i in range(20)], "id long, name string, n int")
    log = [(rnd.choice([None, *range(30)]), rnd.choice(["insert", "update", "update", "delete"]), t, rnd.choice([None, f"v{t}"]), rnd.choice([None, t]))
           for t in range(300)]
    rnd.shuffle(log)
    table = ChangeTable(str(tmp_path / "t"), ("id",), buckets=4, every=3)
    table.create(base, ST.LongType())
    rows = lambda df: sorted(map(tuple, df.select("id", "name", "n", "updated").collect()), key=str)
    assert rows(table.read(spark)) == sorted(((i, f"b{i}", i, None) for i in range(20)), key=str)
    sink, parts = table.sink(), [log[i::7] for i in range(7)]
    for i, part in enumerate(parts):
        batch = spark.createDataFrame(part, CHANGES)
        sink(batch, i)
        want = D.apply_changes(base, spark.createDataFrame([r for p in parts[:i + 1] for r in p], CHANGES), ["id"])
        assert rows(table.read(spark)) == rows(want)
        # Run again, it changes nothing.
        sink(batch, i)
        assert rows(table.read(spark)) == rows(want)
    # Two merges in seven batches, and one batch of log left to read.
    assert sorted(p.name for p in (tmp_path / "t" / "snapshot").iterdir()) == ["version=-1", "version=2", "version=5"]


def test_a_batch_without_manifest_has_no_effect(spark, tmp_path):
    base = spark.createDataFrame([], "id long, name string, n int")
    table = ChangeTable(str(tmp_path / "t"), ("id",), buckets=4, every=1)
    table.create(base, ST.LongType())
    assert table.read(spark).count() == 0
    table.sink()(spark.createDataFrame([(1, "insert", 1, "a", 1), (2, "insert", 1, "b", 2)], CHANGES), 0)
    # A batch that was ended after its snapshot, before its manifest.
    (tmp_path / "t" / "snapshot" / "version=1").mkdir()
    assert [r.id for r in table.read(spark).orderBy("id").collect()] == [1, 2]
    table.sink()(spark.createDataFrame([(1, "delete", 2, None, None)], CHANGES), 1)
    assert [r.id for r in table.read(spark).collect()] == [2]
    # Untouched buckets stay at their version; an empty batch touches none.
    table.sink()(spark.createDataFrame([], CHANGES), 2)
    assert [r.id for r in table.read(spark).collect()] == [2]


def vote(i, minute, applies=True, user="u", fp="f", aspect="bias"):
    return (i, fp, "https://u", None, aspect, "biasDetector", None, applies, None, None, None, user, at(minute))


def test_feedback_resent_after_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    chunks = lambda: spark.createDataFrame([(4, "f")], "chunk_id long, fingerprint string")
    run = lambda: J.feedback_stream(source(spark, src, FEEDBACK_SCHEMA), chunks, out, cp).awaitTermination()
    put(spark, src, "1", [vote(1, 0), vote(1, 0), vote(2, 1, fp="new"), vote(3, 1, aspect="nope")], FEEDBACK_SCHEMA)
    run()
    put(spark, src, "2", [vote(1, 0), vote(4, 2), vote(5, 3, fp="new")], FEEDBACK_SCHEMA)
    run()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert sorted(r.feedback_id for r in read("accepted").collect()) == [1, 2, 4, 5]
    assert [r.feedback_id for r in read("rejected").collect()] == [3]
    assert [r.fingerprint for r in read("stubs").collect()] == ["new"]


def test_feedback_resent_after_days(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    chunks = lambda: spark.createDataFrame([(4, "f")], "chunk_id long, fingerprint string")
    day = 24 * 60
    for i, rows in enumerate([[vote(1, 0), vote(2, 1)], [vote(3, 9 * day)], [vote(1, 0), vote(2, 16 * day), vote(4, 0), vote(3, 16 * day), vote(4, 0)]]):
        put(spark, src, str(i), rows, FEEDBACK_SCHEMA)
        J.feedback_stream(source(spark, src, FEEDBACK_SCHEMA), chunks, out, cp).awaitTermination()
    read = spark.read.parquet(f"{out}/accepted").collect()
    # Vote 4 is nine days late and counts; votes 1 to 3 came again.
    assert sorted((r.feedback_id, r.created) for r in read) == [(1, at(0)), (2, at(1)), (3, at(9 * day)), (4, at(0))]


def test_late_votes_are_dropped_and_minds_changed(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, "1", [vote(1, 0), vote(2, 5, applies=False), vote(3, 9, user="v")], FEEDBACK_SCHEMA)
    put(spark, src, "2", [vote(4, 300)], FEEDBACK_SCHEMA)
    tally = lambda: J.run_available(J.feedback_tally_stream(source(spark, src, FEEDBACK_SCHEMA), "1 hour", "30 minutes"), out, cp).collect()
    # User u's later vote counts; the hour of vote 4 is still open.
    assert [(r.applies, r.applies_not, r.n_events) for r in tally()] == [(1, 1, 3)]
    put(spark, src, "3", [vote(5, 3, user="late"), vote(6, 600)], FEEDBACK_SCHEMA)
    assert sorted((r.applies, r.n_events) for r in tally()) == [(1, 1), (1, 3)]


def test_new_ads_count_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "page_id long, ad_root string, ts timestamp"
    run = lambda: J.run_available(J.new_ads_stream(source(spark, src, schema)), out, cp).count()
    put(spark, src, "1", [(1, "/a", at(0)), (1, "/a", at(1)), (2, "/a", at(1))], schema)
    assert run() == 2
    put(spark, src, "2", [(1, "/a", at(20)), (1, "/b", at(21))], schema)
    assert run() == 3


def test_streamed_scores_equal_batch(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    stream = spark.readStream.schema(pages.schema).option("pathGlobFilter", "pages.parquet").parquet(sf)
    columns = ["page_id", "chunk_pos", "module", "problem_score"]
    got = J.run_available(J.analyze_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).select(*columns)
    want = J.analyze_stream(pages).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_config_is_read_per_batch(spark, tmp_path):
    seen = []
    bundles = lambda: spark.createDataFrame([("b", len(seen), 1, "remote", {"h": {"m": False}})], "bundle_id string, version int, updated_at long, source string, data map<string,map<string,boolean>>")
    run = J.with_config(bundles, "b", lambda batch, rules, i: seen.append(rules.count()))
    for i in range(2):
        run(spark.range(1), i)
    assert seen == [1, 1]
    assert F is not None


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    from checks.stream_checks import stream_config
    pages = spark.createDataFrame([(i, f"https://h{i}.example.org/") for i in range(12)], "page_id long, url string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(3).selectExpr("cast(id as int) as r_regionkey").write.parquet(f"{tmp_path}/region.parquet")
    rows = stream_config(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.off_by_default) for r in rows) == [(i, i % 2 == 0) for i in range(12)]


def test_resent_feedback_comes_in_many_files(spark, sf, tmp_path, monkeypatch):
    from checks import stream_checks
    monkeypatch.setattr(stream_checks, "work_dir", lambda spark, name: f"{tmp_path}/{name}")
    assert stream_checks.stream_resend(spark, sf).count() == 2 * spark.read.parquet(f"{sf}/events.parquet").count()
    home = tmp_path / "stream_resend"
    assert len(list((home / "in").glob("part-*.parquet"))) > 5 and len(list((home / "out/accepted").glob("batch_id=*"))) == 5
