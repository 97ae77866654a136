import pytest
from pyspark.sql import functions as F

from pagegauge.operators import rollup as R, scorers as S, topics as T


def scores(spark, text, title="", module=None, **more):
    names = ["doc_id", "text", "title", *more]
    df = spark.createDataFrame([(1, text, title, *more.values())], names)
    rows = S.score_all(df, [module] if module else None).collect()
    return {r.module: r for r in rows}


def test_bias_direction_and_length(spark):
    row = scores(spark, "progressive liberal " * 30, module="biasDetector")["biasDetector"]
    assert row.flags == ["left_leaning_language", "one_sided_argument"]
    assert row.problem_score == pytest.approx(0.3) and row.metadata["biasDirection"] == "left"
    even = scores(spark, "progressive republican conservative, however", module="biasDetector")["biasDetector"]
    assert even.flags == [] and even.metadata["biasDirection"] == "neutral"


def test_manipulation(spark):
    text = "act now, limited time, last chance. Congratulation!"
    links = [("https://Win.TK/x", "go")]
    df = spark.createDataFrame([(1, text, "shop.tk", links)], "doc_id long, text string, domain string, links array<struct<url:string,text:string>>")
    row = S.score(df, "antiManipulation").first()
    assert row.flags == ["urgency_pressure", "suspicious_domain", "suspicious_links", "poor_grammar_quality"]
    assert row.problem_score == pytest.approx(0.75)
    assert row.explanation.startswith("Multiple scam indicators detected: urgency_pressure, ")


def test_links_without_host_are_harmless(spark):
    df = spark.createDataFrame([(1, "x", [("a.tk", ""), (None, "")])], "doc_id long, text string, links array<struct<url:string,text:string>>")
    assert S.score(df, "antiManipulation").first().flags == []


def test_toxicity(spark):
    row = scores(spark, "You are an idiot. damn it. All of them are stupid", module="defuseRagebait")["defuseRagebait"]
    assert row.flags == ["profanity", "hate_speech", "personal_attacks"]
    assert row.explanation.endswith("Categories: profanity, hate speech.")
    split = scores(spark, "all of\nthem they are stupid", module="defuseRagebait")["defuseRagebait"]
    assert split.flags == ["hate_speech"]  # "them" itself starts the pattern on the second line
    assert scores(spark, "all x\nare stupid", module="defuseRagebait")["defuseRagebait"].flags == []


def test_caps_only_on_request(spark):
    df = spark.createDataFrame([(1, "LOUD WORDS HERE AND MORE " * 6)], "doc_id long, text string")
    assert S.score(df, "defuseRagebait").first().flags == []
    assert S.score(df, S.toxicity_scorer(caps=True)).first().flags == ["excessive_caps"]


def test_clickbait(spark):
    row = scores(spark, "text", "This will amaze you", module="clickUnbait")["clickUnbait"]
    assert row.flags == ["shock_promise", "clickbait"] and row.problem_score == pytest.approx(0.5)
    plain = scores(spark, "Cloudy with light rain", "Weather for Tuesday", module="clickUnbait")["clickUnbait"]
    assert plain.flags == [] and plain.confidence == 0.5
    # The question mark counts at the end of the text, not of the headline.
    assert scores(spark, "is it so?", "No", module="clickUnbait")["clickUnbait"].flags == ["question_headline"]
    assert scores(spark, "is it so?\n", "No", module="clickUnbait")["clickUnbait"].flags == []


def test_missing_text_scores_as_empty(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert {r.problem_score for r in S.score_all(df).collect()} == {0.0}


def test_register_scorer(spark):
    shout = S.Scorer("shout", "toxicity", lambda v: [("loud", 0.9, F.contains(v.text, F.lit("!")))],
                     lambda s, f: F.lit(1.0), lambda s, f, h: F.lit("x"))
    S.register_scorer(shout)
    try:
        assert scores(spark, "hey!")["shout"].flags == ["loud"]
    finally:
        del S.SCORERS["shout"]


def test_rules_run_once_and_in_codegen(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = S.score_all(df, ["biasDetector"])._jdf.queryExecution().executedPlan().toString()
    # Twice: the count is compared with the left words and with the right ones.
    assert plan.count("Contains(_lower") and "Filter" not in plan


def test_complete_scores_fills_defaults(spark):
    df = spark.createDataFrame([(7, "unknownModule", 0.4)], "doc_id long, module string, problem_score double")
    row = S.complete_scores(df, ["doc_id"]).first()
    assert (row.aspect, row.method, row.model, row.confidence, row.flags) == ("accuracy", "unknownModule", "heuristic", 0.0, [])
    assert row.id == "unknownModule-7" and row.metadata == {"moduleId": "unknownModule"}


def test_errors_do_not_count(spark):
    from pagegauge.operators import rollup as R
    rows = [(1, "biasDetector", "bias", 0.8, 0.6, ["a"], None), (1, "clickUnbait", "clickbait", 0.0, 0.0, [], "boom")]
    df = spark.createDataFrame(rows, "doc_id long, module string, aspect string, problem_score double, confidence double, flags array<string>, error string")
    summary = R.summarize_chunks(df, ["doc_id"]).first()
    assert summary.problem_score == 0.8 and summary.overall_risk == "very-high" and len(summary.flags) == 1
    assert R.nutrition_label(df.where("module = 'clickUnbait'"), ["doc_id"]).first().label == "No Data"


# --- errors, topics -----------------------------------------------------------------

def test_failing_rows_carry_an_error(spark):
    share = lambda v: F.try_divide(F.col("hits"), F.col("total"))
    strict = S.Scorer("share", "bias", lambda v: [("many", 0.5, share(v) > 0.5), ("dated", 0.3, F.try_to_timestamp(F.col("day")).isNotNull() | F.col("day").isNull())],
                      lambda score, flags: F.lit(0.8), lambda score, flags, hits: F.array_join(flags, ","), strict=True)
    rows = [(0, "x", 3, 4, "2024-01-01"), (1, "x", 1, 0, "2024-01-01"), (2, "x", 1, 4, "no day"), (3, None, None, 4, None), (4, "", 4, 4, "2024-13-01")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits int, total int, day string")
    got = {(r.doc_id, r.module): r for r in S.score_all(df, [strict, "biasDetector"]).collect()}
    assert [got[i, "share"].error for i in range(5)] == [None, "many: no result", None, "many: no result", None]
    assert [got[i, "share"].problem_score for i in range(5)] == [0.8, None, 0.0, None, 0.5]
    assert got[1, "share"].flags == [] and got[1, "share"].confidence is None and got[0, "share"].flags == ["many", "dated"]
    assert all(got[i, "biasDetector"].error is None and got[i, "biasDetector"].problem_score == 0 for i in range(5))
    long = R.summarize_chunks(S.score_all(df, [strict, "biasDetector"]), ["doc_id"]).orderBy("doc_id").collect()
    arrays = R.summarize_chunk_arrays(S.with_scores(df, [strict, "biasDetector"]), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.problem_score for r in long] == [r.problem_score for r in arrays] == [0.4, 0.0, 0.0, 0.0, 0.25]
    module = R.summarize_page_modules(S.score_all(df.withColumn("p", F.lit(1)), [strict], ["p", "doc_id"]), ["p"], ["doc_id"]).first()
    assert module.n_chunks == 3 and module.problem_score == pytest.approx(1.3 / 3)
    filled = S.complete_scores(S.score_all(df, [strict]), ["doc_id"]).where("error is not null").collect()
    assert len(filled) == 2 and all(r.problem_score == 0 and r.confidence == 0 for r in filled)
    assert "error" not in S.score(df, "biasDetector").columns


def test_topics(spark):
    lexicon = spark.createDataFrame([("sea", "Boat", 1.0), ("sea", "wave", 0.5), ("air", "plane", 1.0), ("air", "wave", 0.5), (None, "boat", 9.0), ("zero", None, 1.0)],
                                    "topic string, term string, weight double")
    texts = ["A boat, a BOAT; a plane", "wave", "boat-plane", "nothing", None, "", "boats", "plane " * 30_000 + "boat", "wave wave"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"topic_": F.lit("mine"), "weight": F.lit(1)})
    got = {r.doc_id: (r.topic, r.weight) for r in T.topics(df, lexicon, ["doc_id"], 0.75).collect()}
    assert got == {0: ("sea", 2.0), 1: (None, None), 2: ("air", 1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None),
                   7: ("air", 30_000.0), 8: ("air", 1.0)}
    assert T.topics(df, lexicon.limit(0), ["doc_id"]).where("topic is null").count() == 9
    assert T.topics(df.limit(0), lexicon, ["doc_id"]).count() == 0
