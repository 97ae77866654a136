"""Exact dedup, spelling variants and collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegauge.llm import exact, phrases, variants

LOWER = {i: i + 32 for i in range(65, 91)}


def test_exact_copies(spark):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "Ä same", "ä same", "A copy", "a COPY", "x" * 100_000, f"own {i}", f"own {i}"]) for i in range(400)]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(399, texts[399], "mine"), (None, "a copy", "mine"), (None, "alone", "mine")]
    # Columns of the table may be named like what the operator adds or uses.
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumns({"id": F.lit(1), "row": F.lit(2), "place": F.lit(3)})
    got = exact.exact_copies(df).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(rows) and all((r.id, r.row, r.place) == (1, 2, 3) for r in got)
    kept = Counter()
    for r in got:
        own = (r.text or "").translate(LOWER)
        best = max((i for i in groups[own] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.text_sha256) == (best, len(groups[own]), hashlib.sha256(own.encode()).hexdigest())
        assert not r.kept or r.doc_id == best
        kept[own] += r.kept
    assert set(kept.values()) == {1}
    assert exact.exact_copies(df.limit(0)).count() == 0
    assert exact.exact_copies(df, columns=["doc_id"]).columns == ["doc_id", "text_sha256", "keep_id", "group_size", "kept"]


def test_rows_without_copies_are_not_shuffled(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 1900).cast("string")).alias("text"))
    written = []
    monkeypatch.setattr(exact, "saved", lambda t, name, save=exact.saved: written.append((name, out := save(t, name))) or out)
    assert exact.exact_copies(df).where("kept").count() == 1900
    # 200 rows have a copy; of the others only a few fall on cells of theirs.
    assert 200 <= dict(written)["repeated"].count() < 260
    # A filter that is full lets all rows through to the grouping, with the same result.
    monkeypatch.setattr(exact, "filter_size", lambda n: 1 << 16)
    monkeypatch.setattr(exact, "bits_set", lambda bits, cells: np.ones(cells.shape, bool))
    assert exact.exact_copies(df).where("kept").count() == 1900


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("classes", [1, 3])
def test_spelling_variants(spark, monkeypatch, classes):
    monkeypatch.setattr(variants, "classes_for", lambda n: classes)
    monkeypatch.setattr(variants, "BLOCK", 16)  # so that profiles have several blocks
    rng = random.Random(2)
    words = {"".join(rng.choices("abÿ×", k=rng.randrange(5, 7))): rng.choice([3, 3, 6, 12, 24, 48]) for _ in range(250)}
    got = {r.word: r for r in variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got.keys() == words.keys()
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    for w, r in got.items():
        root = w
        while forms[root]:
            root = forms[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (words[w], len(near[w]), forms[w], forms[w] and words[forms[w]], root)
    assert any(forms.values()) and any(forms[f] for f in forms.values() if f)


def test_count_words(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i]), " ".join(rng.choices(["Straße", "Été-né", "naïve", "abc", "Ünder9long", "Őszi"], k=200))) for i in range(40)] + [(1, None), (2, ""), (3, "z" * 50_000)]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += len(w) >= 5
    got = {r.word: r.n for r in variants.count_words(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0))).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and got
    assert variants.spelling_variants(variants.count_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def brute_collocations(rows, least, most):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        ranked = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:most], 1)]
    return sorted(out)


def test_collocations(spark):
    rng = random.Random(4)
    words = ["New", "york", "city", "café", "of", "the", "a", " x"]
    rows = [(rng.choice([" ", "  ", "\t"]).join(rng.choices([*words, "new york city hall", "the. End"], k=rng.randrange(0, 25))), rng.choice(["en", "fr", None])) for _ in range(250)]
    rows += [(None, "en"), ("", "fr"), (".,;", "xx"), ("Again and again and again " * 3000, "fr")] + [("same row here", "en")] * 40
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"n": F.lit("mine"), "phrase": F.lit(0), "h": F.lit(0)})
    got = [tuple(r) for r in phrases.collocations(df.repartition(3), 8, most=60).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == brute_collocations(rows, 8, 60) and len(got) > 100


def test_equal_numbers_of_phrases_do_not_add_up(spark):
    # Two words with one number: together they reach the threshold, alone they do not.
    seen = {}
    a, b = next((seen[n], w) for i in range(10**6) for w in [f"w{i}"] for n in [phrases.word_number("en", w.encode())] if seen.setdefault(n, w) != w)
    rows = [(f"{a} and more", "en")] * 6 + [(f"{b} and more", "en")] * 6 + [("six five four", "en")] * 5
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string").coalesce(1), 10).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert sorted(got) == brute_collocations(rows, 10, 2000) and [r[2] for r in got] == ["and more"]
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
