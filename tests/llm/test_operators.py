"""Each corpus operator against plain Python, with nulls, empty and long texts, ties, repeats and clashing columns."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import public_tokenizers
from pagegauge.llm import chat, common, decontaminate, jaccard, passages, personal, pieces, quality, secrets, topk, toxicity
from pagegauge.llm.components import connected

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, *texts, extra="text string"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"doc_id long, {extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- toxicity and quality --------------------------------------------------------------

def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"plain words number {i} " + ("1d1ot go on" if bad else "trash can by the door" if i % 30 == 3 else "go on") + " end"))
        labels.append((i, 0 if i % 5 == 0 else 1, int(bad)))
    rows += [(400 + i, f"this is trash number {i}") for i in range(60)]
    labels += [(400 + i, 1, 1) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    assert toxicity.fold("ＩＤiоt 1d10t $cum! p@th​etic") == "idiot idiot scum! pathetic".replace("l", "i")
    d, labels = labelled(spark)
    lexicon = toxicity.learn_lexicon(d, labels)
    assert "idiot" in lexicon.weights and "trash can" in lexicon.exceptions
    tests = docs(spark, "what an IDIOT", "the trash can", "idiots are idiotic", None, "", "x " * 100_000 + "idiot", "what an IDIOT")
    got = toxicity.score_toxicity(tests.withColumn("toxic_words", F.lit("mine")), lexicon).orderBy("doc_id").collect()
    assert got[0].toxic_words == ["idiot"] and got[0].toxicity >= 0.5 and got[0].toxicity == got[6].toxicity
    assert [got[i].toxic_words for i in (1, 2, 3, 4)] == [[]] * 4 and got[1].toxicity < 0.5
    assert got[5].toxicity < got[0].toxicity or lexicon.power == 0
    assert toxicity.score_toxicity(empty(spark), lexicon).count() == 0
    assert toxicity.learn_lexicon(empty(spark), labels.limit(0)).weights == {}


def test_toxicity_learns_from_whole_texts(spark):
    rows = [(i, "scum " * 500 + f"idiot number {i}" if i % 4 == 0 else f"plain words number {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert lexicon.weights.keys() >= {"scum", "idiot"}


def test_quality(spark):
    rows = [(i, ("word and other words here " * 5) if i % 3 else "BUY!! NOW!! %%% " * 9) for i in range(300)]
    labels = [(i, int(i % 3 > 0), int(i % 6 == 1)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.learn_quality(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score_quality(docs(spark, rows[1][1], rows[0][1], None, "").withColumn("tails", F.lit(1)), model).orderBy("doc_id").collect()
    assert got[0].tails[0] > 0.5 > got[1].tails[0] and got[2].tails == got[3].tails
    assert got[0].expected_grade == pytest.approx(sum(got[0].tails)) and got[0].tails[0] >= got[0].tails[1]
    assert quality.score_quality(empty(spark), model).count() == 0
    assert not quality.learn_quality(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).weights.any()


# --- top-k ------------------------------------------------------------------------------

def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.integers(-3, 4, 3) / 8).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)]
    vectors += [(2000, None), (2050, [None, 1.0, 1.0]), (2100, [float("nan"), 0.0, 0.0]), (2150, [1.0]), (None, [1.0, 1.0, 1.0]), vectors[0]]
    ready = topk.integer_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in topk.top_k(ready, F.expr("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    known = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in known if i % 50 == 0):
        want = sorted((-sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))[:5]
        assert got.get(q, []) == [(i, -s) for s, i in want]
    assert topk.top_k(ready.limit(0), F.expr("vec_id % 50 = 0")).count() == 0


def test_cover_tree_bounds():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (8, 4))
    points = np.concatenate([c + rng.integers(-9, 10, (200, 4)) for c in centres])
    tree = topk.Tree(points, np.arange(len(points)))
    assert len(tree.start) > 8 and sorted(tree.ids) == list(range(len(points)))
    for s, e, c, r in zip(tree.start, tree.end, tree.centre, tree.radius):
        assert (np.sqrt(((tree.points[s:e] - tree.points[c]) ** 2).sum(1)) <= r).all()


# --- secrets, personal data -----------------------------------------------------------------

PLAIN = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
} | {k: re.compile(e) for k, e, _ in secrets.RULES[3:]}


def test_secrets(spark):
    rng = random.Random(2)
    atoms = ["token", "secret", "Api_Key", "APIKEY", "passwd", "=", ":", " ", "'", '"', "abcdef0123", "AKIA", "ABCD1234", "é", "deadbeefdeadbeef",
             "-----BEGIN ", "RSA PRIVATE KEY-----", "ghp_", "xoxb-", "eyJ", ".", "AIza", "a" * 20, "_", "-"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "f" * 200_000, "token=abcdefghijkl", "token=abcdefghijkl"]
    least = {k: n for k, _, n in secrets.RULES}
    rank = {k: i for i, (k, _, _) in enumerate(secrets.RULES)}
    for r in secrets.find_secrets(docs(spark, *texts).withColumn("spans", F.lit(0))).collect():
        want = sorted((m.start(), rank[k], k, m.end()) for k, p in PLAIN.items() for m in p.finditer(r.text or "")
                      if (len(m[2]) >= 12 if k == "assign" else len(m[0]) >= least[k]))
        assert [(s.start, rank[s.kind], s.kind, s.end) for s in r.spans] == want
    assert secrets.find_secrets(empty(spark)).count() == 0


FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal(spark):
    rng = random.Random(4)
    atoms = ["a@b.c", "%d@e.f", "@", "."," ", "-", "1", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (132) 555-1352",
             "+", "(", "é", "\U0001f600", "\n", "..", ".com", "192.168.0.1", "0007"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + [None, "", "a@b.cc " * 700 + "1 " * 50_000, "a@b.cc", "a@b.cc"]
    texts += [f"hello my mail is ann{i}777@x.org now" for i in range(30)] + ["hello my mail is bob9777_at_x now"]
    marked = personal.find_personal(docs(spark, *texts).withColumn("spans", F.lit(0))).withColumn("masked", personal.masked("text", "spans"))
    got = {r.doc_id: r for r in marked.collect()}
    for i, text in enumerate(texts):
        want = sorted((m.start(), rank, k, m.end()) for rank, (k, p) in enumerate(FORMATS.items()) for m in re.finditer(p, text or "", re.A) if holds(k, m[0]))
        assert [(s.start, s.kind, s.end) for s in got[i].spans if s.kind != "context"] == [(s, k, e) for s, _, k, e in want]
    last = got[len(texts) - 1]
    assert [(s.kind, last.text[s.start:s.end]) for s in last.spans] == [("context", "bob9777_at_x")]
    assert last.masked == "hello my mail is [CONTEXT] now" and got[1500].masked is None and got[1503].masked == "[EMAIL]"
    assert personal.find_personal(empty(spark)).count() == 0


def test_personal_beside_any_columns(spark):
    names = ["m_email", "f_card", "s_phone", "c_ip", "d_ip", "m_id", "key", "t", "_text", "_base", "_new", "_row", "text_hash", "a.b"]
    rows = docs(spark, "write to a@b.cc", None, "", "write to a@b.cc").withColumns({n: F.lit(n) for n in names})
    got = personal.find_personal(rows).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in got] == [[("email", 9, 15)], [], [], [("email", 9, 15)]]
    assert all(r[n] == n for r in got for n in names) and [r.text for r in got] == ["write to a@b.cc", None, "", "write to a@b.cc"]


# --- decontamination -------------------------------------------------------------------------

def test_decontaminate(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "é9", "Zz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 22)))) for i in range(25)] + [(98, None), (None, "a b c d"), (3, "a b")]
    texts = [rng.choice([" ", "-"]).join(rng.choice(items)[1] or "" if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(4)) for _ in range(150)]
    texts += [None, "", texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, *texts).withColumn("hits", F.lit("mine"))
    for chars in (1 << 20, 60):
        for r in decontaminate.find_shared(d, bench, block_chars=chars).collect():
            own, hit, found = words(r.text), set(), set()
            for item, text in items:
                w = words(text)
                n = min(13, len(w))
                for j in range(len(w) - n + 1) if n and item is not None else ():
                    at = [k for k in range(len(own) - n + 1) if own[k:k + n] == w[j:j + n]]
                    hit |= {p for k in at for p in range(k, k + n)}
                    found |= {item} if at else set()
            assert (r.n_words, r.n_hit, r["items"]) == (len(own), len(hit), sorted(found))
            assert {p for s in r.hits for p in range(s.start, s.end)} == hit
    assert {r.n_hit for r in decontaminate.find_shared(d, bench.limit(0)).collect()} == {0}
    assert decontaminate.find_shared(empty(spark), bench).count() == 0


# --- passages, Jaccard join ------------------------------------------------------------------------

def test_passages(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared, line = fresh(80), fresh(10)
    fuzzy = [w if i % 17 else "x" for i, w in enumerate(shared)]
    del fuzzy[40]
    texts = [" ".join(p) for p in (fresh(30) + shared + fresh(9), fresh(200), fresh(70) + fuzzy + fresh(5), fresh(60) + line, line + fresh(60), shared, ["the"] * 300)]
    texts += [texts[1], "", None, "word", texts[6], " ".join(fresh(20)) + " " + texts[6]]
    d = docs(spark, *texts)
    got = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(d.unionByName(d.limit(3))).collect()}
    assert set(got) == {(2, 0), (5, 0), (7, 1), (11, 6), (12, 6)}
    assert 75 <= got[2, 0].end - got[2, 0].start <= 80 and 70 <= got[2, 0].start <= 75 and 0.85 < got[2, 0].similarity < 1
    assert (got[5, 0].start, got[5, 0].end, got[5, 0].source_start) == (0, 80, 30) and got[7, 1].n_same == 200
    assert passages.repeated_passages(empty(spark)).count() == 0


def test_equal_passages_held_twice(spark):
    rng = random.Random(63)
    fresh = lambda n: fresh_words(rng, n)
    shared, line = fresh(60), fresh(12)
    texts = [fresh(30) + line + fresh(40) + shared + line, fresh(10) + shared + fresh(80) + shared + fresh(7) + shared, line * 40, fresh(5) + line * 40 + fresh(9) + line * 6]
    got = passages.repeated_passages(docs(spark, *[" ".join(t) for t in texts])).collect()
    assert {(r.start, r.end, r.source_id, r.source_start) for r in got if r.doc_id == 1} == {(10, 70, 0, 82), (150, 210, 0, 82), (217, 277, 0, 82)}
    places = {p for r in got if r.doc_id == 3 for p in range(r.start, r.end)}
    # The nine words between lie inside one passage of similarity 0.8 or more.
    assert places == {*range(5, 566)}


def fresh_words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def test_passages_align_the_words_of_a_slice_at_a_time(spark, monkeypatch):
    written, there = [], []

    def saved(df, name, *by):
        table = common.saved(df, name, *by)
        written.append((name, table.stored_at))
        there.append({n for n, at in written if os.path.exists(at.removeprefix("file:").replace("///", "/"))})
        return table

    monkeypatch.setattr(passages, "saved", saved)
    shared = [[f"s{k}x{i}" for i in range(70)] for k in range(12)]
    texts = [" ".join(s) for s in shared] + [" ".join([f"a{k}y{i}" for i in range(20)] + s) for k, s in enumerate(shared)]
    got = passages.repeated_passages(docs(spark, *texts))
    # Names and seeds are gone when words are aligned, and words and chains when the result is returned.
    names = [n for n, _ in written]
    assert [n for n in names if n.startswith("found_")] == [f"found_{i}" for i in range(passages.SLICES)]
    assert not there[names.index("found_0")] & {"names", "held"}
    assert not any(os.path.exists(at.removeprefix("file:").replace("///", "/")) for n, at in written if n in ("chains", "blocks"))
    ids = sorted(r.doc_id for r in docs(spark, *texts).select("doc_id").collect())
    assert {(r.doc_id, r.source_id, r.start, r.end) for r in got.collect()} == {(ids[12 + k], ids[k], 20, 90) for k in range(12)}


def test_passages_exchange_the_seeds_of_a_slice_at_a_time(spark, monkeypatch):
    """A slice of the stored seeds is gone when the next one is exchanged; copies are left out all the same."""
    path, names = [], []

    def saved(df, name, *by):
        if name == "held":
            left = {d for d in os.listdir(path[0]) if d.startswith("slice=")}
            assert not left & {f"slice={i}" for i in range(names.count("held"))}
        names.append(name)
        table = common.saved(df, name, *by)
        if name == "seeds":
            path.append(re.sub("^file:/*", "/", table.stored_at))
        return table

    monkeypatch.setattr(passages, "saved", saved)
    monkeypatch.setattr(jaccard, "MARKS", 1 << 16)
    shared = [f"s{i}" for i in range(120)]
    texts = [" ".join([f"a{i}x{j}" for j in range(30)] + shared + [f"b{i}x{j}" for j in range(30)]) for i in range(3)]
    got = passages.repeated_passages(docs(spark, *texts, texts[1])).collect()
    assert sorted((r.doc_id, r.start, r.end, r.source_id, r.source_start) for r in got) == [(1, 30, 150, 0, 30), (2, 30, 150, 0, 30), (3, 0, 180, 1, 0)]
    assert names.count("held") == passages.SEED_SLICES > 1


def test_passages_read_no_words_around_hopeless_chains(spark, monkeypatch):
    """Short phrases that two texts share make chains, but no words are read again for them."""
    tables = {}

    def saved(df, name, *by):
        tables[name] = common.saved(df, name, *by)
        if name == "blocks":
            tables["read"] = {r.of for r in tables[name].select("of").collect()}
        return tables[name]

    monkeypatch.setattr(passages, "saved", saved)
    rng = random.Random(65)
    lines = [fresh_words(rng, 9) for _ in range(4)]
    shared = fresh_words(rng, 60)
    texts = [fresh_words(rng, 30) + [w for i, x in enumerate(lines) for w in x + fresh_words(rng, 15 + i + k)] for k in range(6)]
    texts += [texts[0][:20] + shared + fresh_words(rng, 9), fresh_words(rng, 9) + [w if i % 9 else "x" for i, w in enumerate(shared)]]
    got = passages.repeated_passages(docs(spark, *[" ".join(t) for t in texts])).collect()
    assert [(r.doc_id, r.source_id) for r in got] == [(7, 6)]
    assert tables["read"] == {6, 7}


def test_hopeless_chains_hold_no_passage():
    rng = random.Random(66)
    seen = set()
    for _ in range(300):
        words = rng.choice([5, 50, 10 ** 6])
        rate = rng.choice([0, 0.1, 0.2, 0.3, 0.6])
        a = np.array([rng.randrange(words) for _ in range(rng.choice([30, 80, 150]))], np.uint32) * np.uint32(2654435761)
        b = np.array([rng.randrange(words) for _ in range(rng.randrange(70))] + [
            w for v in a.tolist() for w in ([v], [], [rng.randrange(10 ** 6)])[0 if rng.random() >= rate else rng.randrange(3)]], np.uint32)
        points = {(i, j) for i in range(len(a) - 3) for j in range(len(b) - 3) if (a[i:i + 4] == b[j:j + 4]).all() and rng.random() < 0.5}
        for chain in passages.chains(*zip(*points)) if len(points) > 1 else ():
            x, y = map(list, zip(*chain))
            low = [w.astype(np.uint8)[max(0, c[0] - passages.REACH):c[-1] + passages.GRAM + passages.REACH].tobytes() for w, c in ((a, x), (b, y))]
            good = bool(list(passages.alike(chain, a, b, 0, 0)))
            likely = passages.hopeful([x], [y], *[[r] for r in low])[0]
            assert likely or not good
            seen.add((likely, good))
    assert {(True, True), (False, False)} <= seen


def test_passages_beside_documents_that_hold_parts(spark):
    rng = random.Random(61)
    fresh = lambda n: fresh_words(rng, n)
    texts, wanted = [], set()
    for n, parts in ((60, ((0, 40), (20, 60))), (90, ((0, 45), (45, 90))), (50, ((0, 25), (25, 50))), (70, ((0, 30), (20, 49), (40, 70)))) * 5:
        shared = fresh(n)
        between = [fresh(9) + shared[a:b] + fresh(9) for a, b in parts]
        wanted.add((len(texts) + 2 * len(parts) + 1, len(texts) + len(parts)))
        texts += [*between, fresh(20) + shared + fresh(5), *[fresh(7) + p for p in between], fresh(8) + shared + fresh(30)]
    got = passages.repeated_passages(docs(spark, *[" ".join(t) for t in texts])).collect()
    assert wanted <= {(r.doc_id, r.source_id) for r in got if r.similarity == 1}


def test_changed_passages_whose_seeds_all_lead_elsewhere(spark, monkeypatch):
    rng = random.Random(66)
    fresh = lambda n: fresh_words(rng, n)
    texts, wanted = [], set()
    for step in (9, 10, 12, 15):
        shared = fresh(60)
        # Other documents, smaller than the source and between the two, hold all seeds, in too short parts.
        parts = lambda: [fresh(16) + shared[i:i + 13] + fresh(80) for i in range(0, 57, 10)]  # noqa: B023, E731
        wanted.add((len(texts) + 13, len(texts) + 6))
        texts += [*parts(), fresh(20) + shared + fresh(5), *parts(), fresh(8) + [w if i % step else "x" for i, w in enumerate(shared)] + fresh(30)]
    d = docs(spark, *[" ".join(t) for t in texts])
    for few in (passages.FEW, 0):
        monkeypatch.setattr(passages, "FEW", few)  # 0: several blocks of documents
        monkeypatch.setattr(passages, "BLOCKS", 3)
        got = {(r.doc_id, r.source_id): r for r in passages.repeated_passages(d).collect()}
        assert set(got) == wanted and all(r.end - r.start >= 55 and r.similarity >= 0.85 for r in got.values())


def test_passages_of_the_promised_similarity(spark):
    rng = random.Random(62)
    texts, wanted = [], set()
    for step in (5, 6, 7, 8, 10, 12, 15) * 6:
        shared = fresh_words(rng, 60)
        wanted.add((len(texts) + 1, len(texts)))
        texts += [fresh_words(rng, 20) + shared, fresh_words(rng, 30) + [w if i % step else "x" for i, w in enumerate(shared)] + fresh_words(rng, 9)]
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(docs(spark, *[" ".join(t) for t in texts])).collect()}
    # Seeds are sampled, so a passage at the very limit (every fifth word) may be missed now and then.
    assert got <= wanted and len(wanted - got) <= 1


def test_passages_held_twice(spark):
    rng = random.Random(63)
    fresh = lambda n: fresh_words(rng, n)
    shared, line = fresh(60), fresh(12)
    changed = [w if i % 9 else "x" for i, w in enumerate(shared)]
    texts = [
        fresh(30) + line + fresh(40) + shared + line, fresh(10) + shared + fresh(80) + changed + fresh(70) + shared + fresh(7),
        line * 40, fresh(5) + line * 40 + fresh(90) + line * 6]
    got = passages.repeated_passages(docs(spark, *[" ".join(t) for t in texts])).collect()
    places = [{p for r in got if r.doc_id == doc for p in range(r.start, r.end)} for doc in range(4)]
    assert places[1] == {*range(10, 70), *range(151, 210), *range(280, 340)}
    assert places[3] == {*range(5, 485), *range(575, 647)}


def test_passages_on_both_sides_of_an_insertion(spark):
    rng = random.Random(64)
    fresh = lambda n: fresh_words(rng, n)
    shared = fresh(126)
    got = passages.repeated_passages(docs(spark, " ".join(shared), " ".join(fresh(4) + shared[:40] + fresh(50) + shared[40:] + fresh(9)))).collect()
    assert [(r.start, r.end, r.source_start, r.n_same) for r in got] == [(94, 180, 40, 86)]


def test_chains_are_best():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 9)
        x, y = ([rng.randrange(60) for _ in range(n)] for _ in range(2))
        points = sorted(zip(x, y))
        score = {}
        for i, p in enumerate(points):
            score[i] = passages.SEED_SCORE + max([0.0] + [score[j] - passages.GAP_COST * (p[0] - q[0] + p[1] - q[1]) for j, q in enumerate(points[:i]) if q[0] < p[0] and q[1] < p[1]])
        top = max(score.values())
        found = passages.chains(x, y)
        value = lambda c: len(c) * passages.SEED_SCORE - passages.GAP_COST * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(c, c[1:]))
        assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))
        assert top == pytest.approx(max(map(value, found), default=passages.SEED_SCORE))


@pytest.mark.parametrize("n,percent,bound", [(4, 85, None), (2, 60, None), (3, 75, 2)])
def test_jaccard(spark, monkeypatch, n, percent, bound):
    if bound:  # many small groups, so that the matrix has to find links, and few marks
        for name, value in (("GROUP_SETS", bound), ("OWN_GROUPS", bound), ("MARKS", 256)):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(260):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        texts.append(" ".join(w[:rng.choice([60, 60, 58])]))
    texts += [None, "", "  ", "A b", "a  B", "one", texts[0].upper(), " ".join(f"z{i}" for i in range(5000))]
    words = lambda t: [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    sets = [frozenset(tuple(w[j:j + min(n, len(w))]) for j in range(len(w) - min(n, len(w)) + 1)) if w else frozenset() for w in map(words, texts)]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and label[i] != label[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    d = docs(spark, *texts).withColumn("n", F.lit("mine")).withColumn("name", F.lit(0))
    got = jaccard.jaccard_components(d.unionByName(d.limit(2)), n, percent).distinct().collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard_two_texts(spark):
    """A document in two rows links with what either of its texts links with, however much their sizes differ."""
    long = [f"w{i}" for i in range(400)]
    short = [f"s{i}" for i in range(30)]
    rows = [(1, " ".join(long)), (1, " ".join(short)), (2, " ".join([*long[:399], "x"])), (3, " ".join([*short[:29], "y"])), (4, "z " * 40)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_jaccard_holds_the_groups_of_a_slice_at_a_time(spark, monkeypatch):
    """Token sets are stored for one slice of the families at a time, and postings are dealt out by token once."""
    stored, exchanges = [], []

    def saved(df, name, *by):
        if name == "postings":
            exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(token"))
        if name == "groups":
            assert not any(os.path.exists(p) for p in stored)
        table = common.saved(df, name, *by)
        if name == "groups":
            stored.append(re.sub("^file:/*", "/", table.stored_at))
            assert os.path.exists(stored[-1])
        return table

    monkeypatch.setattr(jaccard, "saved", saved)
    texts = [" ".join(f"w{i % 20}x{j}" for j in range(40)) + (" end" if i >= 20 else "") for i in range(40)]
    got = jaccard.jaccard_components(docs(spark, *texts)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i % 20) for i in range(40)]
    assert len(stored) == jaccard.GROUP_SLICES > 1 and exchanges == [1] * jaccard.SLICES


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (None, 1)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200}


# --- tokens, chats ------------------------------------------------------------------------------------

def test_a_worker_keeps_one_encoder_and_nothing_of_other_operators(spark):
    texts = [f"word{i} and \u2581 \u6f22\U0001f600 " * 9 for i in range(40)] + ["", None, " x"]
    # One worker, two tasks after each other: the second finds the first one's encoder, and what another operator left is gone.
    encoded = pieces.encode_texts(docs(spark, *texts).coalesce(1), MODEL)
    assert encoded.count() == len(texts)
    jaccard._known[b"word"] = 1
    vocabulary = spark.sparkContext.broadcast(pieces.read_vocabulary(MODEL))
    first = pieces.encoder_of(7, vocabulary)
    assert pieces.encoder_of(7, vocabulary) is first and not jaccard._known
    assert pieces.encoder_of(8, vocabulary) is not first and list(pieces._ready) == [8]
    pieces._ready.clear()
    # The task asks the module's own function, not a copy that ends with the task.
    assert "_ready" not in {name for c in pieces.encode_texts.__code__.co_consts if hasattr(c, "co_names") for name in c.co_names}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in encoded.collect():
        ids = library.encode(r.text or "", add_eos=True)
        assert (list(r.ids), r.decoded) == (ids, library.decode(ids))


def test_pieces(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab  e▁théß \n\t\x00�你\U0001f600ction12") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", " ", "   x  ", "word " * 50_000, "z" * 3000, "word"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in pieces.encode_texts(docs(spark, *texts).withColumn("ids", F.lit(0)), MODEL).collect():
        want = library.encode(r.text or "", add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
    assert pieces.encode_texts(empty(spark), MODEL).count() == 0


def cheapest(roles, rules=chat.Rules()):
    """Shortest way through all repairs by plain search."""
    costs = {("START", 0): 0.0}
    left = [("START", 0)]
    best = float("inf")
    while left:
        at = min(left, key=costs.get)
        left.remove(at)
        (state, i), cost = at, costs[at]
        steps = [((role, i), rules.insert) for role in rules.after[state]]
        if i < len(roles):
            name = {r: 0.0 if r == roles[i] else rules.relabel if roles[i] in rules.states[1:] else rules.name_unknown for r in rules.states[1:]}
            steps += [((r, i + 1), name[r]) for r in rules.after[state]] + ([((state, i + 1), rules.merge + name[state])] if state != "START" else [])
        elif state in rules.last:
            best = min(best, cost)
        for to, more in steps:
            if cost + more < costs.get(to, float("inf")):
                costs[to] = cost + more
                if to not in left:
                    left.append(to)
    return best


def test_chat(spark):
    rng = random.Random(10)
    names = ["system", "user", "assistant", None, "tool"]
    chats = {c: [rng.choice(names) for _ in range(rng.randint(1, 7))] for c in range(60)}
    chats[100] = ["user" if i % 3 else "assistant" for i in range(1300)]
    rows = [(c, t, r, f"t{c}.{t}", "x") for c, roles in chats.items() for t, r in enumerate(roles)] + [(None, 0, " USER ", None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = defaultdict(list)
    for r in chat.format_chats(table.unionByName(table)).orderBy("conv_id", "block").collect():
        got[r.conv_id].append(r)
    for c, roles in chats.items():
        assert sum(r.cost for r in got[c]) == cheapest(roles) and sum(r.n_in for r in got[c]) == len(roles)
        whole = "".join(r.rendered for r in got[c])
        assert re.findall(r"t\d+\.\d+", whole) == [f"t{c}.{t}" for t in range(len(roles))]
        after = "START"
        for role in re.findall(r"<\|(\w+)\|>", whole.replace("<|end|>", "")):
            assert role in chat.Rules().after[after]
            after = role
        assert after == "assistant"
    assert len(got[100]) == 3 and got[None][0].rendered == "<|user|>\n\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert chat.format_chats(table.limit(0)).count() == 0
