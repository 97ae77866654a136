"""Spelling variants by blocked Gram matrices.

A word is the vector of its letter counts. One letter put in or left out changes the squared distance of two vectors by one,
one letter replaced by two (or not at all where the letters are the same ones in another order), so words that differ by one
edit are at most two apart and of equal or adjacent lengths. Words lie in blocks of one length and one profile (how many of
their letters fall in each class of letters). Pairs of blocks whose profiles one edit can join are multiplied as matrices; pairs
of words at most two apart are then compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices, small_batches

#: The letters: a-z and U+00C0 to U+00FF. Their places in a vector, by code point.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
RUN_OF_LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a block at most (a profile with more has several blocks), and different words that a task counts before it reports.
BLOCK, HELD = 2048, 200_000
_LOWER = {i: i + 32 for i in range(65, 91)}
_PLACE = np.full(256, -1, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 5, least_n: int = 3, one_in: int = 97) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, with `least_length` letters and `least_n` occurrences at least.

    Where `one_in` divides the unsigned crc32 h of `<doc_id>:<word>`, the word loses its letter number h % length (from 0): planted
    misspellings, the same in every run. A null doc_id counts as an empty one; null texts have no words. Tasks count
    before anything is shuffled, so a frequent word is no hot key; a text of any length is read whole.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for own_id, own in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{own_id or ''}:".encode())
                for word, n in Counter(RUN_OF_LETTERS.findall((own or "").translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % one_in:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield report()
                    held.clear()
        if held:
            yield report()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def letter_classes(words: DataFrame, n: int) -> dict[int, list[str]]:
    """The letters in classes of about equal mass: the commonest letter left goes to the lightest class."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    mass, classes = [0] * n, [[] for _ in range(n)]
    for letter, many in sorted(((r[0], r[1]) for r in counts if r[0]), key=lambda x: (-x[1], x[0])):
        lightest = mass.index(min(mass))
        mass[lightest] += many
        classes[lightest].append(letter)
    return dict(enumerate(classes))


def classes_for(words: int) -> int:
    """More words, more classes: blocks stay small, and any number gives the same result."""
    return int(min(12, max(2, round(1.5 * np.log10(words + 1) - 3.4))))


def vectors(words: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, given as a matrix of code points."""
    out = np.zeros((len(words), len(LETTERS)), np.float32)
    rows = np.arange(len(words))
    for column in _PLACE[words].T:
        out[rows, column] += 1
    return out


def near(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of words of a and b that one edit makes equal. same: a is b, and each pair is given once."""
    squares = (va * va).sum(1)[:, None] + (vb * vb).sum(1)[None, :] - 2 * (va @ vb.T)
    i, j = np.nonzero(squares <= 2)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    x, y = a[i], b[j]
    if a.shape[1] == b.shape[1]:
        good = (x != y).sum(1) == 1
    else:
        # y is longer by one: x agrees with it up to some place, and from there on with what follows the next letter.
        front = np.cumprod(np.concatenate([np.ones((len(x), 1), np.int8), x == y[:, :-1]], axis=1), axis=1, dtype=np.int8)
        back = np.cumprod(np.concatenate([np.ones((len(x), 1), np.int8), (x == y[:, 1:])[:, ::-1]], axis=1), axis=1, dtype=np.int8)[:, ::-1]
        good = (front & back).any(1)
    return i[good], j[good]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (least, word): for every word with near words their number and the one of largest n, as struct<least:
    long, word: string> with least = -n; ties go to the smallest word in code-point order. words: word, n, each word once.

    A block holds BLOCK words at most. Pairs of blocks are made from profiles that one edit can join, never from pairs of
    words; a task sends one row for each word of a block, with the number of its near words and the best of them.
    """
    total = words.count()
    classes = letter_classes(words, classes_for(total))
    profile = F.concat_ws(",", *(
        F.length("word") - F.length(F.regexp_replace("word", f"[{''.join(letters)}]", "")) if letters else F.lit(0) for letters in classes.values()))
    profiled = words.select("word", "n", F.length("word").alias("length"), profile.alias("profile"))
    crowd = profiled.groupBy("length", "profile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    dealt = profiled.join(crowd, ["length", "profile"]).withColumn("part", F.pmod(F.xxhash64("word"), "parts"))
    blocks = saved(dealt.groupBy("length", "profile", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows")).select(
        "length", "profile", "part", F.array_join("rows.word", "").alias("words"), F.col("rows.n").alias("ns")), "blocks")

    # Profiles that one edit leads to: the same one (a letter replaced within its class), one more letter in some class, or
    # one more in some class and one fewer in another; of two profiles of one length the smaller in order of arrays looks up.
    counts = F.split("profile", ",").cast("array<int>")
    n = len(classes)

    def changed(up: int, down: int | None = None):
        return F.concat_ws(",", *(F.col("counts")[i] + ((i == up) - (i == down)) for i in range(n)))

    replaced = [changed(up, down) for up in range(n) for down in range(up + 1, n)]
    steps = [F.struct(F.lit(0).alias("more"), p.alias("other")) for p in (F.col("profile"), *replaced)]
    steps += [F.struct(F.lit(1).alias("more"), changed(up).alias("other")) for up in range(n)]
    left = blocks.withColumn("counts", counts).select(
        "length", "profile", "part", "words", "ns", F.explode(F.array(*steps)).alias("step")).select(
        F.col("length").alias("l_length"), F.col("profile").alias("l_profile"), F.col("part").alias("l_part"), F.col("words").alias("l_words"),
        F.col("ns").alias("l_ns"), (F.col("length") + F.col("step.more")).alias("length"), F.col("step.other").alias("profile"))
    itself = (F.col("l_length") == F.col("length")) & (F.col("l_profile") == F.col("profile"))
    pairs = left.join(blocks, ["length", "profile"]).where(~itself | (F.col("l_part") <= F.col("part"))).select(
        "l_length", "l_words", "l_ns", "length", "words", "ns", (itself & (F.col("l_part") == F.col("part"))).alias("same"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                l_length, l_words, l_ns, length, text, ns, same = (batch.column(c)[k].as_py() for c in range(7))
                a, b = (np.frombuffer(t.encode("latin-1"), np.uint8).reshape(-1, size) for t, size in ((l_words, l_length), (text, length)))
                i, j = near(a, b, vectors(a), vectors(b), same)
                if not len(i):
                    continue
                # Both directions: i and j are near each other.
                ends = [(i, j, l_words, l_length, text, length, ns), (j, i, text, length, l_words, l_length, l_ns)]
                words_, many, least, best = [], [], [], []
                for own, other, own_text, own_size, other_text, other_size, other_ns in ends:
                    other_n = np.array(other_ns, np.int64)[other]
                    order = np.lexsort((other, -other_n, own))  # words of a block are sorted, so the smaller place is the smaller word
                    first = order[np.concatenate([[True], np.diff(own[order]) > 0])]
                    words_ += [own_text[x * own_size:(x + 1) * own_size] for x in own[first].tolist()]
                    many.append(np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0])), [len(own)]])))
                    least.append(-other_n[first])
                    best += [other_text[x * other_size:(x + 1) * other_size] for x in other[first].tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(words_, pa.string()), pa.array(np.concatenate(many), pa.int64()), pa.array(np.concatenate(least), pa.int64()),
                    pa.array(best, pa.string())], names=["word", "n_near", "least", "other"])

    found = pairs.mapInArrow(multiply, "word string, n_near long, least long, other string")
    table = saved(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", F.col("other").alias("word"))).alias("best")), "near")
    discard(blocks)
    return table


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n; each word once, of the letters of LETTERS).

    Near words differ by exactly one letter put in, left out or replaced. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that is `times` the word's n at least, else null; its root is where forms lead in the end,
    the word itself if it has none. An empty table gives an empty one.
    """
    words = saved(words.select("word", "n"), "words")
    near_ = near_words(words)
    is_form = F.expr(f"-best.least >= {times} * n")
    rows = saved(words.join(near_, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n")), "forms")
    discard(words, near_)
    # n at least doubles from a word to its form, so a path has 63 steps at most; each round doubles what is walked.
    at = saved(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = further.select("word", "root")
        at.stored_at = further.stored_at
        if further.where("moved").isEmpty():
            break
    return rows.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
