import json
import random

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import clickbait as B, claims as C
from pagegauge.sources.tables import read_fact_checks, read_golden

REVIEW = "array<struct<publisher:string,url:string,title:string,review_date:string,textual_rating:string,language_code:string>>"


def facts(spark, *rows):
    data = [(i, text, None, None, [("P", "u", "t", "", r, "en") for r in ratings]) for i, (text, ratings) in enumerate(rows)]
    df = spark.createDataFrame(data, f"fact_id long, text string, claimant string, claim_date string, reviews {REVIEW}")
    return C.with_review_defaults(df)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def claims(spark, text, **options):
    return [r.claim for r in C.extract_claims(docs(spark, text), ["doc_id"], **options).orderBy("claim_pos").collect()]


def test_claims(spark):
    text = "Short one. The moon landing was a hoax they say! According to nobody it happened? Plain words come and go here. It is real enough now. Yet another sentence is not here"
    every = ["The moon landing was a hoax they say", "According to nobody it happened", "It is real enough now", "Yet another sentence is not here"]
    assert claims(spark, text) == every and claims(spark, text, max_claims=3) == every[:3]
    assert len(claims(spark, " ".join(f"Number {i} is a claim of its own." for i in range(12)))) == 12
    assert claims(spark, "Words without any pattern go here. And more of them follow there.") == [
        "Words without any pattern go here", "And more of them follow there"]
    assert claims(spark, "tiny") == [] and claims(spark, None) == []
    # With a limit, a longer claim is no claim, but may stand in when there is none.
    long = "It is " + "x" * 600
    two = docs(spark, long + ". This is short but fine", long)
    assert claims(spark, long + ". This is short but fine") == [long, "This is short but fine"]
    limited = {r.doc_id: r.claims for r in C.with_claims(two, max_chars=500).collect()}
    assert limited == {0: ["This is short but fine"], 1: [long]}


@pytest.mark.parametrize("ratings,want", [(["False"], 0.0), (["mostly TRUE", "false"], 0.4), (["what"], 0.5), ([], 0.5), (["Pants on fire"], 0.0)])
def test_ratings(spark, ratings, want):
    assert facts(spark, ("x", ratings)).select(C.rating_score(F.col("reviews"))).first()[0] == pytest.approx(want)


def test_accuracy(spark):
    known = facts(spark, ("The earth is  a FLAT disc", ["false"]), ("the earth is a flat disc", ["true"]), ("Water is a liquid thing", ["true"]))
    rows = {r.doc_id: r for r in C.score_accuracy(
        docs(spark, "The earth is a flat disc. Water is a liquid thing.", "The earth is a flat disc.", "Nothing is a match here.", "hi", "!!!!!!!!!!!!!", None),
        known, ["doc_id"]).collect()}
    assert rows[0].problem_score == pytest.approx(0.5) and rows[0].flags == ["fact_checked"] and "Found 3 fact-check(s)" in rows[0].explanation
    assert rows[1].problem_score == 1.0 and rows[1].flags == ["fact_checked", "mostly_false"] and rows[1].confidence == 0.8
    assert rows[2].flags == ["no_fact_checks_found"] and rows[2].confidence == 0.3
    assert rows[3].flags == ["insufficient_content"] and rows[4].flags == ["no_claims_found"] and rows[5].flags == ["insufficient_content"]
    assert C.score_accuracy(docs(spark, "x"), None, ["doc_id"]).first().flags == ["no_api_key"]


def test_fuzzy_match_takes_the_nearest(spark):
    known = facts(spark, ("the quick brown fox jumps over a dog", ["false"]), ("the quick brown fox jumps over a cat", ["true"]), ("unrelated words entirely", ["true"]))
    found = C.match_fact_checks(
        spark.createDataFrame([(1, "The quick, brown fox jumps over a CAT!"), (2, "nothing like it")], "doc_id long, claim string"), known, "fuzzy", 0.6)
    assert {r.doc_id: r.fact_id for r in found.collect()} == {1: 1, 2: None}


def test_candidates_are_pruned_by_place_and_signature(spark):
    # One frequent word in every text; only the pair of equal texts shares more.
    texts = [(f"hot {' '.join(f'x{i}y{j}' for j in range(9))}",) for i in range(40)]
    df = spark.createDataFrame(texts, "claim_key string")
    words = df.select(F.unhex(F.md5("claim_key")).alias("id"), F.explode(C.word_set(F.col("claim_key"))).alias("word"))
    ranks = words.groupBy("word").agg(F.count("*").alias("freq"))
    posted = C.prefix_postings(words, ranks, 0.3)
    assert {(r.n, r.pos) for r in posted.where("word = 'hot'").collect()} <= {(10, 10)}
    assert C.candidate_pairs(posted, posted, 0.3).where("l_id <> r_id").count() == 0
    assert C.similar_texts(df, df, 0.3).count() == 40


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_texts_equals_all_pairs(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    make = lambda n: [" ".join(rng.sample(words, rng.randint(2, 7))) for _ in range(n)]
    # A third of the left side are copies of one text.
    left, right = make(60) + ["w1 w2 w3 w4"] * 30, make(40)
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "claim_key string")
    got = {(r.claim_key, r.match_key): r.similarity for r in C.similar_texts(df(left), df(right), threshold).collect()}
    want = {}
    for a in set(left):
        for b in set(right):
            x, y = set(a.split()), set(b.split())
            s = len(x & y) / len(x | y)
            if s >= threshold - 1e-9:
                want[a, b] = s
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_report_and_page_totals(spark):
    known = facts(spark, ("Water is a liquid thing", ["true", "false"]), ("water is a liquid thing", []))
    found = C.extract_claims(docs(spark, "Water is a liquid thing. Ice is a solid thing indeed."), ["doc_id"])
    rows = C.fact_check_report(found, known, ["doc_id"]).orderBy("claim_pos", "fact_id").collect()
    assert [(r.rating, r.band) for r in rows] == [("true", "true"), ("Unknown", "other"), ("none found", None)]
    total = C.page_fact_checks(C.match_fact_checks(found, known), ["doc_id"]).first()
    assert (total.claims_checked, total.fact_checks_found, total.average_rating) == (2, 1, 0.5)


def test_fact_check_files(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"text": "T", "claimReview": [{"textualRating": "False", "publisher": {}}]}) + "\n" + json.dumps({"claimant": "C"}))
    rows = {r.text: r for r in read_fact_checks(spark, str(tmp_path)).collect()}
    review, = rows["T"].reviews
    assert (review.publisher, review.language_code, review.textual_rating) == ("Unknown", "en", "False")
    assert rows[""].reviews == [] and rows[""].claimant == "C"


def test_golden_files(spark, tmp_path):
    doc = {"inputs": {"url": "https://x.org"}, "outputs": {"pageMetadata": {"title": "T"}, "analysisResult": {"status": "completed", "results": [
        {"chunkId": "c1", "statements": [{"type": "claim", "summaryText": "S", "analyses": [{"type": "bias", "problemScore": 0.4, "flags": ["f"]}]}]},
        {"chunkId": "c2", "statements": []}]}}}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    rows = read_golden(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.statement, r.problem_score) for r in rows] == [("c1", "S", 0.4), ("c2", None, None)]
    assert rows[0].url == "https://x.org" and rows[0].flags == ["f"]


# --- clickbait ----------------------------------------------------------------------

@pytest.mark.parametrize("summary,title,n,want,rewritten", [
    ("Bridge shut until May", "Drivers are furious", 90, "[Bridge shut until May] Drivers are furious", True),
    ("", "Seven towns ranked", 90, "Seven towns ranked", False),
    ("[[Rates up]]", "Banks react", 90, "[Rates up] Banks react", True),
    ("Rain", "bc" * 50, 30, "[Rain] " + "bc" * 11 + "…", True),
    ("Z" * 93, "Ends here", 90, "[" + "Z" * 93 + "] …", True),
    ("Toll", "mile " * 20, 21, "[Toll] mile mile mil…", True),
])
def test_format(spark, summary, title, n, want, rewritten):
    row = spark.range(1).select(B.format_unbait_title(F.lit(summary), F.lit(title), n).alias("s")).select("s.*").first()
    assert row.display_title == want and row.rewritten == rewritten and len(row.hover_title) == len(title.strip())


def chunk(spark, *rows):
    return spark.createDataFrame(
        [(i, 0, *r) for i, r in enumerate(rows)],
        "page_id long, chunk_pos int, title string, text string, links array<struct<url:string,text:string>>, page_url string, "
        "flags array<string>, problem_score double, explanation string")


def test_unravel_outcomes(spark):
    goal = "<title>River path opens on Sunday | Town Paper</title><p>Walkers have waited for it. More."
    pages = spark.createDataFrame([
        (10, "https://ex.org/b", goal), (11, "https://ex.org/b#x", "<title>Later copy</title>"),
        (12, "https://ex.org/same", "<title>Bait</title><p>Tea. x"), (13, "https://ex.org/empty", "<p> "),
        (14, "https://ex.org/bar", "<title>| only a bar</title>")], "page_id long, url string, html string")
    at = "https://s.org/q?x"
    bait = (["viral_tease"], 0.5, "why")
    rows = B.unravel_clickbait(chunk(
        spark,
        ("Bait", "t", [("#a", ""), ("/q", ""), ("https://EX.org/b#top", "")], at, *bait),
        ("Bait", "t", [("https://gone.org", "")], at, *bait),
        ("Bait", "t", [("mailto:x", "")], at, ["clickbait"], 0.1, ""),
        ("bait", "t", [("https://ex.org/same", "")], at, *bait),
        ("Bait", "t", [("https://ex.org/empty", "")], at, *bait),
        ("Fine", "t", [("https://ex.org/b", "")], at, [], 0.39, ""),
        (None, " first\tline \nsecond", [("https://ex.org/b", "a long link text")], at, *bait),
        (None, " first\tline \nsecond", [("https://ex.org/bar", "tiny")], at, *bait),
    ), pages).orderBy("page_id").collect()
    got = {r.page_id: r for r in rows}
    assert {i: r.outcome for i, r in got.items()} == {
        0: "unbaited", 1: "no_page", 2: "no_link", 3: "no_summary", 4: "no_page", 6: "unbaited", 7: "no_summary"}
    assert got[0].display_title == "[River path opens on Sunday] Bait" and got[0].flags == ["viral_tease", "clickbait", "unbaited"]
    assert got[0].explanation == "Unbaited: River path opens on Sunday" and got[0].destination_url == "https://ex.org/b#top"
    assert got[2].explanation == "Clickbait detected; no link to unravel."
    assert got[6].original_title == "a long link text" and got[7].original_title == "first line"


def test_model_summary_wins(spark):
    pages = spark.createDataFrame([(1, "https://ex.org/b", "<title>Title</title>")], "page_id long, url string, html string")
    replies = spark.createDataFrame([(0, 0, 'ok {"summary": " [Honest] words "}')], "page_id long, chunk_pos int, reply string")
    row = B.unravel_clickbait(chunk(spark, ("Bait", "t", [("https://ex.org/b", "")], "https://s.org", ["clickbait"], 0.5, "w")), pages, replies).first()
    assert row.honest_summary == "Honest] words"


def test_title_target(spark):
    def pick(links, title, heads=None):
        row = spark.range(1).select(B.title_target(
            F.array(*[F.lit(x) for x in links]).cast("array<string>"), F.lit(title),
            None if heads is None else F.array(*[F.lit(x) for x in heads])).alias("t")).first().t
        return row and (row.kind, row.pos)
    assert pick(["", "Other one", " the  TITLE "], "The title") == ("link", 2)
    assert pick(["zzz"], "The title", ["x", "So: the title"]) == ("heading", 1)
    assert pick(["no", "some long link"], "The title", ["x"]) == ("link", 1)
    assert pick(["no"], "The title") is None


def test_exact_matches_repeat_no_verdict(spark):
    known = facts(spark, ("Water is a liquid thing", ["true"]), ("Ice is a solid thing", ["false"]))
    found = spark.createDataFrame([(i, 0, "water is  a liquid thing" if i % 3 else "steam") for i in range(60)], "doc_id long, claim_pos int, claim string")
    matched = C.match_fact_checks(found, known)
    assert "explode([0,1" not in matched._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.fact_id, r.rating) for r in matched.collect()) == [(i, 0 if i % 3 else None, 1.0 if i % 3 else None) for i in range(60)]
    report = C.fact_check_report(found, known, ["doc_id"])
    assert "explode([0,1" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.n_claims, r.rating) for r in report.collect()) == [(20, "none found"), (40, "true")]


def test_texts_of_unknown_words_are_not_posted(spark):
    known = spark.createDataFrame([("a b c d",)], "claim_key string")
    asked = spark.createDataFrame([("a b c x",), ("a b u v x y",)], "claim_key string")
    words = lambda df: df.select(
        F.unhex(F.md5("claim_key")).alias("id"), C.word_set(F.col("claim_key")).alias("held")).select(
        "id", F.size("held").alias("n"), C.word_signature("held").alias("signature"), F.explode("held").alias("word"))
    ranks = words(known).groupBy("word").agg(F.count("*").alias("freq"))
    posted = C.prefix_postings(words(asked), ranks, 0.6).collect()
    assert [(r.n, r.pos, r.word) for r in posted] == [(4, 2, "a")]
    assert [(r.claim_key, r.similarity) for r in C.similar_texts(asked, known, 0.6).collect()] == [("a b c x", 0.6)]
