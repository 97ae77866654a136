"""Search, stored documents, settings, roll-ups, feedback, models."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import feedback as B, models as M, rollup as R, search as Q, settings as G, store as D
from pagegauge.functions import text as T
from pagegauge.functions.joins import hot_keys, salted_join

# --- search -----------------------------------------------------------------------


def test_parse():
    assert Q.parse_search("apples oranges").op == "AND" and Q.parse_search("apples OR oranges").op == "OR"
    assert Q.parse_search(None).terms == () and str(Q.parse_search("")) == ""
    both = Q.parse_search('(apples OR oranges) AND (bananas OR "two words")')
    assert both.op == "AND" and [t.op for t in both.terms] == ["OR", "OR"]
    assert str(both) == '(apples OR oranges) AND (bananas OR "two words")'
    assert Q.parse_search("lang:en (fruit:apple OR fruit:orange)").terms[0] == Q.Term("en", "lang")
    assert str(Q.parse_search("a (b OR c")) == "a AND (b OR c)"


def test_props():
    assert Q.search_prop("lang:en apples", "lang") == "en" and Q.search_prop("apples", "lang") is None
    assert str(Q.with_prop("apples", "lang", "en")) == "apples AND lang:en"
    assert str(Q.with_prop("", "lang", "en")) == "lang:en"
    assert Q.search_prop(Q.with_prop("lang:en apples", "lang", "fr"), "lang") == "fr"
    assert str(Q.with_prop("lang:en apples", "lang", None)) == "apples" and str(Q.with_prop("lang:en", "lang", "")) == ""
    assert str(Q.with_prop("", "v", "foo bar")) == 'v:"foo bar"' and Q.search_prop('v:"foo bar"', "v") == "foo bar"
    assert str(Q.with_prop(None, "flag", False)) == "flag:false"
    assert str(Q.with_any_prop("apples", "v", ["a", "b c"])) == 'apples AND (v:a OR v:"b c")'
    with pytest.raises(ValueError):
        Q.with_any_prop(None, "v", [])


def test_combine():
    assert str(Q.search_all("a", "b")) == "a AND b" and str(Q.search_any("a b", "c")) == "(a AND b) OR c"
    assert str(Q.search_all("a OR b", "c OR d")) == "(a OR b) AND (c OR d)" and str(Q.search_any("a OR b", "c")) == "a OR b OR c"
    assert str(Q.search_all(None, "b")) == "b" and str(Q.search_any("a", "")) == "a"
    assert str(Q.search_without("foo AND bar", "bar")) == "foo" and str(Q.search_without("foo lang:en", "lang:en")) == "foo"


def test_search_rows(spark):
    df = spark.createDataFrame([(1, "Red Apples", "en", '{"k": "7"}'), (2, "pears", "de", None), (3, None, "en", "bad")], "id int, text string, lang string, props string")
    ids = lambda q: [r.id for r in Q.search(df, q, ["text"], "props").orderBy("id").collect()]
    assert ids("apples") == [1] and ids("apples OR lang:de") == [1, 2] and ids(None) == [1, 2, 3]
    assert ids("lang:en k:7") == [1] and ids("(apples OR pears) lang:de") == [2] and ids('"red apples"') == [1]
    assert ids("nothing:here") == []


def test_list_items_refuses_unknown_sort(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "id int, title string")
    assert [r.id for r in Q.list_items(df, sort="title").collect()] == [2, 1]
    for bad in ("title; drop", "text", "id sideways"):
        with pytest.raises(ValueError):
            Q.list_items(df, sort=bad)


def test_saved_searches_with_a_hot_word(spark):
    docs = spark.createDataFrame([(i, "the common word" + (" rare" if i % 10 == 0 else "")) for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common AND rare"), (2, "rare OR missing"), (3, "the and"), (4, "Common")], "query_id int, query string")
    hits = {r.query_id: r["count"] for r in Q.match_saved_searches(docs, queries, ["doc_id"]).groupBy("query_id").count().collect()}
    assert hits == {1: 6, 2: 6, 4: 60}


def test_saved_searches_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(0, 12))), rng.choice(["en", "de", None])) for i in range(150)] + [(150, None, "en")]
    searches = [(i, rng.choice([" AND ", " OR ", " "]).join(rng.choices([*words, "lang:en", "absent"], k=rng.randrange(0, 5)))) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.query_id) for r in Q.match_saved_searches(
        docs, spark.createDataFrame(searches, "query_id int, query string"), ["doc_id"], "text", ["lang"]).collect()]
    want = set()
    for d, text, lang in texts:
        held = {*(text or "").split(), f"lang:{lang or ''}"}
        for q, search in searches:
            terms = set(search.split()) - ({"OR"} if " OR " in search else {"AND"})
            if terms and (terms & held if " OR " in search else terms <= held):
                want.add((d, q))
    assert len(got) == len(set(got)) and set(got) == want and want


def test_anchor_is_the_rarest_term(spark):
    terms = Q.search_terms(spark.createDataFrame([(1, "common AND rare"), (2, "common OR rare"), (3, "rare gone"), (4, "")], "query_id int, query string"))
    frequency = spark.createDataFrame([("common", 1000), ("rare", 2)], "word string, n long")
    assert {(r.query_id, r.word) for r in Q.search_anchors(terms, frequency).collect()} == {(1, "rare"), (2, "common"), (2, "rare")}


# --- stored documents ---------------------------------------------------------------


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, name string, n int")
    log = spark.createDataFrame([
        (1, "update", 1, None, 10), (1, "update", 2, "a2", None),        # merged
        (2, "delete", 1, None, None), (2, "update", 2, "gone", None),    # an update does not bring it back
        (4, "update", 1, "never", 1),                                    # no such item
        (5, "insert", 1, "e", None), (5, "delete", 2, None, None), (5, "insert", 3, None, 5),
    ], "id long, op string, ts long, name string, n int")
    rows = {r.id: (r.name, r.n, r.updated) for r in D.apply_changes(base, log, ["id"]).collect()}
    assert rows == {1: ("a2", 10, 2), 3: ("c", 3, None), 5: (None, 5, 3)}


def test_props_round_trip(spark):
    items = spark.createDataFrame([(1, "t", "x", [1, 2])], "id int, title string, extra string, list array<int>")
    packed = D.pack_props(items, ["id", "title"])
    assert packed.columns == ["id", "title", "props"]
    back = D.unpack_props(packed, "extra string, list array<int>, title string, id int").first()
    assert (back.id, back.title, back.extra, back.list) == (1, "t", "x", [1, 2])
    merged = D.merge_props(
        spark.createDataFrame([(1, '{"a":"1","b":"2"}'), (2, "{}")], "id int, props string"),
        spark.createDataFrame([(1, 5, '{"b":"3"}'), (1, 4, '{"b":"9","c":"4"}')], "id int, ts int, props string"), ["id"])
    assert {r.id: r.props for r in merged.collect()} == {1: {"a": "1", "b": "3", "c": "4"}, 2: {}}


def test_fingerprints(spark):
    df = spark.createDataFrame([(2, "u", "t", None), (1, "u", "t", ""), (3, None, None, "own")], "id int, url string, title string, fingerprint string")
    marked = D.with_fingerprint(df)
    prints = {r.id: r.fingerprint for r in marked.collect()}
    assert prints[1] == prints[2] != prints[3] == "own"
    assert [r.id for r in D.lookup_fingerprint(marked, marked.where("id = 2")).collect()] == [1]


# --- settings -----------------------------------------------------------------------


def test_settings(spark):
    off = spark.createDataFrame([("https://www.off.org",)], "host string")
    user = spark.createDataFrame([("www.a.org", "biasDetector", False), ("gov.uk", "factChecker", True)], "host string, module string, enabled boolean")
    module = spark.createDataFrame([("clickUnbait", False, None), ("adBlocker", True, False)], "module string, enabled boolean, block_page_ads boolean")
    rules = G.apply_domain_defaults(user, G.shipped_rules(spark))
    settings = G.Settings(off, rules, module)
    pages = spark.createDataFrame([(1, "https://www.a.org/x"), (2, "http://off.org"), (3, "https://www.gov.uk"), (4, "https://b.org"), (5, "https://nhs.uk/")], "page_id long, url string")
    got = {r.page_id: r.modules for r in G.enabled_modules(pages, settings).collect()}
    rest = ["antiManipulation", "defuseRagebait"]
    # The user's switch wins over the shipped one on gov.uk.
    assert got == {1: ["factChecker", *rest], 2: [], 3: ["factChecker", "biasDetector", *rest],
                   4: ["factChecker", "biasDetector", *rest], 5: ["biasDetector", *rest]}
    assert not any(r.block_ads for r in G.ad_blocking_enabled(pages, settings).collect())
    on = G.Settings(off, rules, module.withColumn("block_page_ads", F.lit(None).cast("boolean")))
    assert {r.page_id: r.block_ads for r in G.ad_blocking_enabled(pages, on).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_off_list_edits(spark):
    table = spark.createDataFrame([("a.org", "factChecker", False)], "host string, module string, enabled boolean")
    more = G.add_site(G.add_site(table, "https://www.b.org/x"), "a.org")
    assert {r.host: r.n_off for r in G.off_list(more).collect()} == {"a.org": 1, "b.org": 9}
    assert [r.host for r in G.off_list(G.set_site_module(more, "a.org", "factChecker", True)).collect()] == ["b.org"]
    two = G.set_site_module(table, "a.org", "biasDetector", False)
    assert G.off_list(two).first().modules_off == "Fact Checker, Bias Detector"
    assert G.set_site_module(table, "unknown.org", "biasDetector", False).count() == 1
    assert G.remove_site(more, "b.org").count() == 1


def test_bundles(spark):
    data = "map<string,map<string,boolean>>"
    df = spark.createDataFrame([
        ("x", 1, 5, "bundled", {"a": {"m": False}}), ("x", 2, 9, "remote", {"b": {"m": True}}), ("x", 2, 7, "remote", {"c": {"m": False}}), ("x", 3, 9, "remote", None),
    ], f"bundle_id string, version int, updated_at long, source string, data {data}")
    row = G.current_bundle(df, "x").first()
    assert (row.version, row.updated_at, row.data) == (2, 7, {"c": {"m": False}})
    assert G.bundle_site_rules(G.current_bundle(df)).first()[0:3] == ("c", "m", False)


# --- roll-ups ---------------------------------------------------------------------

@pytest.mark.parametrize("score,risk,light,verdict,band", [
    (0.8, "very-high", "High Risk", "high-risk", "high"), (0.7, "high", "High Risk", "caution", "high"), (0.4, "medium", "Caution", "safe", "medium"),
    (0.3, "low", "Safe", "safe", "medium"), (0.2, "low", "Safe", "safe", "low"), (0.01, "very-low", "Safe", "safe", "low"), (0.0, "unknown", "Safe", "safe", "low")])
def test_band_edges(spark, score, risk, light, verdict, band):
    x = F.lit(score)
    assert tuple(spark.range(1).select(R.risk_band(x), R.traffic_light(x), R.verdict(x), R.display_band(x)).first()) == (risk, light, verdict, band)


SCORES = "page_id long, chunk_pos int, module string, problem_score double, flags array<string>, explanation string, metadata map<string,string>, error string"


def test_page_modules(spark):
    rows = [(1, 1, "biasDetector", 0.4, ["b", "a"], "second", {"k": "2"}, None), (1, 0, "biasDetector", 0.0, [], "first", {"k": "1"}, None),
            (1, 2, "biasDetector", 0.8, ["a", "c"], "third", None, None), (1, 3, "biasDetector", 1.0, ["z"], "bad", None, "err"), (1, 0, "clickUnbait", 1.0, ["clickbait"], "x", None, None)]
    df = spark.createDataFrame(rows, SCORES)
    modules = R.summarize_page_modules(df, ["page_id"], ["chunk_pos"])
    got = {r.module: r for r in modules.collect()}
    bias = got["biasDetector"]
    assert bias.problem_score == pytest.approx(0.4) and bias.flags == ["b", "a", "c"] and bias.n_chunks == 3
    assert bias.explanation == "first" and bias.metadata == {"k": "1"} and bias.confidence == 0.8
    page = R.summarize_pages(modules, ["page_id"]).first()
    assert page.score == pytest.approx(0.7) and page.overall in ("caution", "high-risk")


def test_hot_page(spark):
    df = spark.range(30000).select(
        F.lit(1).alias("page_id"), F.col("id").alias("chunk_pos"), F.lit("biasDetector").alias("module"), F.lit(0.5).alias("problem_score"),
        F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).alias("flags"), F.lit("e").alias("explanation"), F.lit(None).cast("map<string,string>").alias("metadata"))
    row = R.summarize_page_modules(df, ["page_id"], ["chunk_pos"]).first()
    assert row.flags == ["f0", "f1", "f2"] and row.n_chunks == 30000 and row.problem_score == pytest.approx(0.5)


def test_page_status(spark):
    df = spark.createDataFrame([(1, True, None, 3, 2, 0, "safe"), (2, True, None, 3, 900, 100, "high-risk"), (3, False, None, 3, 0, 0, None), (4, True, "x", 0, 0, 0, None), (5, True, None, None, None, None, None), (6, True, None, 1, 0, 0, "caution")],
                               "page_id int, site_enabled boolean, error string, n_chunks int, neutralised int, ads_hidden int, overall string")
    got = {r.page_id: (r.status, r.badge, r.color, r.line) for r in R.page_status(df, "Check").collect()}
    assert got == {
        1: ("completed", "2", "green", "Check: 2 labelled on this page"), 2: ("completed", "999+", "red", "Check: 900 labelled, 100 ads hidden on this page"),
        3: ("excluded", "", "grey", "Check is off for this site"), 4: ("error", "!", "red", "Check: analysis failed"),
        5: ("no_chunks", "", "grey", "Check: no content to analyze"), 6: ("completed", "", "orange", "Check: analysis complete, nothing flagged")}
    busy = spark.createDataFrame([("analyzing", 40), ("idle", 0)], "status string, progress int")
    assert [r.badge for r in R.page_status(busy).collect()] == ["…", ""]


# --- feedback ---------------------------------------------------------------------


def votes(spark, *rows):
    t = dt.datetime(2024, 1, 1)
    full = [(i, fp, "https://u", None, aspect, "biasDetector", None, applies, note, None, None, user, t + dt.timedelta(minutes=i)) for i, (fp, aspect, applies, note, user) in enumerate(rows)]
    return spark.createDataFrame(full, B.FEEDBACK_SCHEMA)


def test_feedback_rules(spark):
    df = votes(spark, ("f", "bias", True, None, "u"), ("", "bias", True, None, "u"), ("f", "nope", True, None, "u"), ("f", None, True, None, "u"),
               ("f", "bias", None, None, "u"), ("f", "bias", False, "x" * 501, "u"), ("f", "bias", False, "x" * 500, "u"))
    ok, bad = B.ingest_feedback(df)
    assert sorted(r.feedback_id for r in ok.collect()) == [0, 6]
    assert {r.feedback_id: r.reject_reason.split()[0] for r in bad.collect()} == {1: "chunkFingerprint", 2: "aspectType", 3: "aspectType", 4: "applies", 5: "message"}


def test_tally_and_stubs(spark):
    df = votes(spark, ("f", "bias", True, None, "u"), ("f", "bias", False, None, "u"), ("f", "bias", True, None, "v"), ("f", "bias", True, None, None), ("f", "bias", True, None, None), ("g", "scams", True, None, "u"))
    got = {r.chunk_fingerprint: (r.applies, r.applies_not, r.n_events) for r in B.tally_feedback(df).collect()}
    assert got == {"f": (3, 1, 5), "g": (1, 0, 1)}
    chunks = spark.createDataFrame([(9, "f"), (4, "f")], "chunk_id long, fingerprint string")
    linked, stubs = B.resolve_feedback(df, chunks)
    assert {r.chunk_fingerprint: r.chunk_id for r in linked.collect()} == {"f": 4, "g": None} and linked.count() == 6
    assert [(r.fingerprint, r.text) for r in stubs.collect()] == [("g", "https://u")]
    # Feedback on a new chunk is linked to the stub made for it.
    stub = stubs.first().stub_id
    assert {(r.chunk_fingerprint, r.stub_id) for r in linked.collect()} == {("f", None), ("g", stub)}


def test_salted_join_equals_plain(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = salted_join(left, right, ["k"], how), left.join(right, "k", how)
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full")


def test_only_hot_keys_are_repeated(spark):
    host = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("h"), F.col("id")))
    left = spark.range(4000).select(host.alias("host"), "id")
    right = left.select("host").distinct().select("host", F.length("host").alias("v"))
    hashes = [r[0] for r in hot_keys(left, ["host"]).collect()]
    assert hashes == [spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]]
    assert hot_keys(left.limit(0), ["host"]).count() == 0
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = salted_join(left, right, ["host"], how, 8, sketch=True), left.join(right, "host", how)
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    # Keys of different types would have different hashes; no row is lost.
    whole = salted_join(left.selectExpr("cast(id % 3 as int) as k", "id"), spark.range(3).withColumnRenamed("id", "k"), ["k"], "inner", sketch=True)
    assert whole.count() == 4000
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        met = salted_join(left, right, ["host"], "inner", 8, sketch=True).withColumn("task", F.spark_partition_id())
        tasks = met.where("host = 'hot'").select("task").distinct().count()
        plain = left.join(right, "host").withColumn("task", F.spark_partition_id()).where("host = 'hot'").select("task").distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plain == 1 and tasks > 2


# --- models ---------------------------------------------------------------------


@pytest.mark.parametrize("reply,score,confidence,flags", [
    ('x {"score": 0.4, "confidence": 0.9, "flags": ["a"]} y', 0.4, 0.9, ["a"]), ('{"problemScore": 7}', 1.0, 0.7, []), ('{"score": -1, "confidence": 0}', 0.0, 0.7, []),
    ("SCORE:  0.65.1 ok", 0.65, 0.5, []), ("no", 0.3, 0.5, []), ("", 0.3, 0.5, []), ("{bad} score: 0.2", 0.2, 0.5, []),
    ('{"labels": ["safe"], "scores": [0.2], "candidateLabels": ["risk", "safe"]}', 0.8, 0.5, ["local_zero_shot"])])
def test_replies(spark, reply, score, confidence, flags):
    row = M.parse_model_replies(spark.createDataFrame([(1, reply)], "doc_id int, reply string"), "biasDetector", ["doc_id"]).first()
    assert row.problem_score == pytest.approx(score) and row.confidence == pytest.approx(confidence) and row.flags == flags


def test_failing_model_falls_back(spark):
    docs = spark.createDataFrame([(1, "damn")], "doc_id int, text string")

    def load():
        def run(prompts):
            raise RuntimeError("out of memory")
        return run

    replies = M.model_replies(M.build_prompts(docs, "defuseRagebait", ["doc_id"]), load, ["doc_id"])
    row = M.score_with_fallback(docs, replies, "defuseRagebait", ["doc_id"]).first()
    assert row.model == "heuristic" and row.problem_score == 0.15 and row.metadata["localModelError"] == "out of memory"
    assert row.metadata["profanity"] == "1"


def test_one_bad_prompt_spoils_no_other(spark):
    docs = spark.createDataFrame([(i, "poison" if i == 3 else "damn") for i in range(6)], "doc_id int, text string").coalesce(1)

    def load():
        def run(prompts):
            if any("poison" in p for p in prompts):
                raise ValueError("bad prompt")
            return ["score: 0.5"] * len(prompts)
        return run

    replies = M.model_replies(M.build_prompts(docs, "defuseRagebait", ["doc_id"]), load, ["doc_id"]).collect()
    assert {r.doc_id: (r.reply, r.error) for r in replies} == {i: (None, "bad prompt") if i == 3 else ("score: 0.5", None) for i in range(6)}


def test_models_get_and_give_whole_texts(spark):
    long, urls = "word " * 1000 + "end", [f"https://a{i}.example.org/" for i in range(9)]
    docs = spark.createDataFrame([(1, long, [(u, "") for u in urls])], "doc_id int, text string, links array<struct<url:string,text:string>>")
    assert docs.select(M.model_text(docs.text)).first()[0] == long and len(docs.select(M.model_text(docs.text, 9)).first()[0]) == 10
    prompt = M.build_prompts(docs, "antiManipulation", ["doc_id"], style="local").first().prompt
    assert all(u in prompt for u in urls)
    said = lambda **cut: M.parse_model_replies(docs.select("doc_id", docs.text.alias("reply")), "biasDetector", ["doc_id"], **cut).first().explanation
    assert said() == long and said(max_explanation=200) == long[:200]
    assert docs.select(T.first_line(docs.text)).first()[0] == long


def test_saved_search_totals_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECES", 20)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=range(1, 26), k=rng.randrange(0, 14))), rng.choice(["en", "de"])) for i in range(120)],
                                 "doc_id long, text string, lang string")
    docs = docs.unionByName(docs.where("doc_id < 10"))  # rows sent twice
    searches = [(i, rng.choice([" AND ", " OR "]).join(rng.choices([*words, "lang:en"], k=rng.randrange(1, 9)))) for i in range(150)]
    queries = spark.createDataFrame(searches, "query_id int, query string")
    pairs = Q.match_saved_searches(docs, queries, ["doc_id"], "text", ["lang"]).collect()
    totals = Q.match_saved_searches(docs, queries, ["doc_id"], "text", ["lang"], totals=True).collect()
    want = {}
    for r in pairs:
        want.setdefault(r.query_id, []).append(r.doc_id)
    assert all(len(v) == len(set(v)) for v in want.values())
    assert {r.query_id: (r.n, r["first"]) for r in totals} == {q: (len(v), min(v)) for q, v in want.items()}


def test_saved_search_totals_are_counted_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(Q, "PIECES", 50)
    monkeypatch.setattr(Q, "GROUP", 7)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(20)]
    texts = [(None if i == 7 else i % 150 - 20, f"k{i % 40}", " ".join(rng.choices(words, weights=range(1, 21), k=rng.randrange(0, 9)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, part string, text string").repartition(3)
    searches = [(i, rng.choice([" AND ", " OR "]).join(rng.choices([*words, "absent"], k=rng.randrange(1, 5)))) for i in range(200)]
    queries = spark.createDataFrame(searches, "query_id int, query string")
    seen = []
    monkeypatch.setattr(Q, "count_pieces", lambda *a, own=Q.count_pieces: seen.append(1) or own(*a))
    once = spark.createDataFrame(texts[:150], "doc_id long, part string, text string").repartition(3)
    for chunks, key in ((once, ["doc_id"]), (docs, ["doc_id", "part"])):
        seen.clear()
        totals = Q.match_saved_searches(chunks, queries, key, totals=True).collect()
        assert len(seen) > 1  # no pair of chunk and search is made
        want = {}
        for r in chunks.collect():
            held = set(r.text.split())
            for q, search in searches:
                terms = set(search.split()) - ({"OR"} if " OR " in search else {"AND"})
                if terms & held if " OR " in search else terms <= held:
                    want.setdefault(q, []).append(tuple(r[k] for k in key))
        least = lambda v: min(v, key=lambda t: [(x is not None, x if x is not None else 0) for x in t])
        for r in totals:
            own = want.pop(r.query_id)
            assert r.n == len(own)
            assert (r["first"] == min((k for k, in own if k is not None), default=None)) if len(key) == 1 else (tuple(r["first"]) == least(own))
        assert not want


def test_saved_searches_keep_any_and_all_of_the_first_words(spark, tmp_path):
    from checks.table_checks import WHOLE, saved_searches
    spark.createDataFrame([(0, "Alpha beta gamma", "en", "s"), (1, "alpha beta delta", "de", "s"), (22, "zeta beta", "en", "s"), (33, "zeta eta", "de", "s")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zeta thing")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.query_id: (r.n, r["first"]) for r in saved_searches(spark, str(tmp_path)).collect()}
    # Even ids: any of two words or English; odd ids: both words and English.
    assert {k: v for k, v in got.items() if k < WHOLE} == {1_000_000: (3, 0), 1_000_001: (1, 0), 1_000_022: (4, 0)}
    assert {k: v for k, v in got.items() if k >= WHOLE}[WHOLE + 1] == (2, 22)
    assert {k - 2 * WHOLE for k in got if k >= 2 * WHOLE} >= {0, 1, 22, 33}
