import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagegauge.functions import text as T, urls as U


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_known_hashes(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("hello world",)], "s string")
    got = rows.select(T.fnv1a_hex(F.col("s")), T.hash31(F.col("s"))).collect()
    assert [r[0] for r in got] == ["811c9dc5", "e40c292c", "bf9cf968", "d58b3fa7"]
    assert got[3][1] == 1794106052 and got[0][1] == 0


def units(text):
    raw = text.encode("utf-16-be", "surrogatepass")
    return [raw[i] * 256 + raw[i + 1] for i in range(0, len(raw), 2)]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), min_size=20, max_size=20))
def test_hashes_and_lengths_follow_utf16(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = rows.select("i", T.fnv1a_hex(F.col("s")), T.hash31(F.col("s")), T.utf16_length(F.col("s")),
                      T.longer_than(F.col("s"), 10)).collect()
    for i, fnv, h31, n, long in got:
        us = units(texts[i])
        h = 2166136261
        k = 0
        for u in us:
            h = ((h ^ u) * 16777619) % 2**32
            k = (k * 31 + u) % 2**32
        assert fnv == f"{h:08x}"
        assert h31 == (k - 2**32 if k >= 2**31 else k)
        assert n == len(us) and long == (len(us) > 10)


def test_text_traps(spark):
    cases = [
        (" a  b\r\n", "a b"), ("", ""), ("  　", ""), ("a  b", "a b"), ("x\x85y", "x\x85y"),
    ]
    rows = spark.createDataFrame(cases, "s string, want string")
    assert all(r[0] == r[1] for r in rows.select(T.collapse_space(F.col("s")), "want").collect())


def test_word_boundaries_are_ascii(spark):
    rows = spark.createDataFrame([("éhell x",), ("shell",), ("hell\n",), ("a** b",), ("a**b",)], "s string")
    hell = [r[0] for r in rows.select(T.matches("s", r"{b}(damn|hell){b}")).collect()]
    assert hell == [True, False, True, False, False]
    stars = [r[0] for r in rows.select(T.matches("s", r"{b}(a\*\*){b}")).collect()]
    assert stars[3:] == [False, True]


def test_titles_and_lines(spark):
    cases = [("One two. Three", "One two."), ("No end", "No end"), ("v1.2 is out! Yes", "v1.2 is out!"), (" \n ", None)]
    rows = spark.createDataFrame(cases, "s string, want string")
    assert all(r[0] == r[1] for r in rows.select(T.first_sentence(F.col("s")), "want").collect())


def test_small_helpers(spark):
    assert one(spark, T.format_count(F.lit(1000))) == "999+"
    assert one(spark, T.format_count(F.lit(0))) == ""
    assert one(spark, T.clamp01(F.lit(1.5))) == 1.0
    assert one(spark, T.clamp01(F.lit(None).cast("double"))) is None
    assert one(spark, T.first_json_object(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert one(spark, T.first_json_object(F.lit("none"))) is None
    assert one(spark, T.decode_entities(F.lit("&amp;lt; &quot;a&#39;&nbsp;"))) == "< \"a' "
    assert one(spark, T.truncate(F.lit("abcdef"), 3)) == "abc…"


def test_urls(spark):
    cases = [
        ("../z?k=1", "https://ex.com/a/b", "https://ex.com/z?k=1"),
        ("//cdn.x/y", "https://ex.com", "https://cdn.x/y"),
        ("?z", "https://ex.com/p?q=1", "https://ex.com/p?z"),
        ("x.html", "http://WWW.Ex.com:80/a/b", "http://www.ex.com/a/x.html"),
        ("javascript:1", "https://ex.com/p", None), ("#a", "https://ex.com/p", None), ("rel", None, None),
        ("HTTP://Q.com", None, "http://q.com/"), ("mailto:a@b", "https://ex.com", "mailto:a@b"),
    ]
    rows = spark.createDataFrame(cases, "h string, b string, want string")
    assert all(r[0] == r[1] for r in rows.select(U.url_resolve(F.col("h"), F.col("b")), "want").collect())
    assert one(spark, U.host_of(F.lit("www.a.org"))) == "a.org"
    assert one(spark, U.host_of(F.lit("http://www.a.org/x|y z"))) == "a.org"
    assert one(spark, U.same_page(F.lit("https://a.org/x?1"), F.lit("https://A.org/x#2"))) is True
    assert one(spark, U.is_platform_host(F.lit("https://m.facebook.com/"))) is True
    assert one(spark, U.is_platform_host(F.lit("https://notfacebook.com/"))) is False


def test_collapse_space_equals_replacing_every_run(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\ufeff"], k=rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = T.js_trim(F.regexp_replace("t", T.SPACE_CLASS + "+", " "))
    assert df.where(T.collapse_space(F.col("t")) != plain).count() == 0
    assert " " not in T.SPACE_RUN.split("]")[0]  # a single space is left as it is
