"""Phrase collocations by dynamic itemset counting.

Texts lie in shards, which are scanned in turn, over and over. Words are counted from the first scan on. As soon as both
subphrases of a longer phrase (all but its last and all but its first word) have reached the threshold, the phrase is counted
from the next scan on, beside whatever other lengths are open, until it has met every shard once. The scans end when nothing
is open any more. They run over words turned to numbers and count numbers of phrases, which keeps what is shuffled small; as
two phrases may have one number, a last scan counts what was found by its words. Scores come from these counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, bits_set, discard, saved, slices, small_batches

#: Shards of a cycle, and words of a phrase at most (its length less one is in the last two bits of its number).
SHARDS, LONGEST = 2, 4
#: Bits of a filter of phrases for each phrase, at least and at most (2^27 bits are 16 MB to send): a filter that is too small
#: lets phrases be counted that are not open yet, which the exact windows leave out again.
BITS_A_PHRASE, FEWEST, MOST = 32, 1 << 16, 1 << 27
#: Bytes of text and numbers of words that a task counts at once, different words that it remembers,
#: and words of a row of numbers.
RUN, TOKENS, REMEMBERED, ROW = 4 << 20, 2_000_000, 500_000, 1 << 15
#: The byte between pieces; no UTF-8 text holds it.
EDGE = b"\xff"
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def joined(front: np.ndarray, last: np.ndarray, m: int) -> np.ndarray:
    """The numbers of phrases of m words from those of their fronts and of their last words."""
    h = (front ^ (front >> np.uint64(31))) * _PRIME + last
    return (h ^ (h >> np.uint64(29))) & ~np.uint64(3) | np.uint64(m - 1)


def word_number(lang: str, word: bytes) -> int:
    """A number of 32 bits, not 0."""
    return xxhash.xxh32_intdigest(word, xxhash.xxh32_intdigest(lang)) or 1


def of_words(numbers: np.ndarray) -> np.ndarray:
    """The 64-bit numbers of words as phrases of one word."""
    return numbers * _PRIME & ~np.uint64(3)


Filter = tuple[int, np.ndarray]


def number_filter(numbers: DataFrame, many: int) -> Filter:
    """A filter of `many` phrases (h, lately): its size in bits, and the bits of all followed by those of the late ones."""
    size = min(MOST, max(FEWEST, 1 << (many * BITS_A_PHRASE).bit_length()))
    own = [f"shiftrightunsigned(h, {shift}) & {size - 1}L" for shift in (2, 34)]
    cells = numbers.select(F.explode(F.filter(F.array(*map(F.expr, [*own, *(f"if(lately, {size}L + ({c}), null)" for c in own)])), lambda c: c.isNotNull())).alias("cell"))
    return size, bit_table(cells, 2 * size)


def in_filter(filter_: Filter, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase: is it in the filter, and as a late one?"""
    size, bits = filter_
    a, b = ((h >> np.uint64(shift) & np.uint64(size - 1)).astype(np.int64) for shift in (2, 34))
    known = bits_set(bits, a) & bits_set(bits, b)
    return known, known & bits_set(bits, size + a) & bits_set(bits, size + b)


class Words:
    """The different words of one language that a task has met, by their numbers."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.begin()

    def begin(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[EDGE]
        self.names: list[bytes] = [EDGE]
        self.numbers = np.zeros(1, np.uint64)

    def places(self, texts: list[bytes]) -> np.ndarray:
        """The ids of all words of the texts in order, 0 between pieces and after each text."""
        if len(self.ids) > REMEMBERED:
            self.begin()
        tokens = b"".join(t + EDGE for t in texts).replace(EDGE, b" \xff ").split()
        at = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        if len(self.ids) > len(self.names):
            new = list(islice(self.ids, len(self.names), None))
            self.names += new
            self.numbers = np.concatenate([self.numbers, np.fromiter((word_number(self.lang, w) for w in new), np.uint64, len(new))])
        return at


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def known_phrases(x: np.ndarray, filter_: Filter, late_only: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For numbers of words in order (0 between pieces) and each length m from 2 on: m, the places where a phrase of m words has
    both its subphrases in the filter (one of them as a late one, with late_only), and the numbers of these phrases."""
    h = of_words(x)
    last = h
    known, lately = in_filter(filter_, h)
    known &= x > 0
    for m in range(2, LONGEST + 1):
        n = len(x) - m + 1
        if n <= 0:
            return
        inside = np.flatnonzero(known[:n] & known[1:n + 1])
        longer = joined(h[inside], last[inside + m - 1], m)
        if late_only:
            wanted = lately[inside] | lately[inside + 1]
            yield m, inside[wanted], longer[wanted]
        else:
            yield m, inside, longer
        if m < LONGEST:
            h, known, lately = np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, bool)
            h[inside] = longer
            known[inside], lately[inside] = in_filter(filter_, longer)


def clean_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Languages and their texts, A-Z lower-cased, with EDGE between pieces and spaces between words."""
    for batch in slices(batches, "text", RUN):
        by_lang: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_lang[lang].append(text.encode().translate(_CLEAN))
        yield from by_lang.items()


def number_shards(rows: DataFrame) -> DataFrame:
    """numbers (binary, of four bytes each: the words of some texts in order, 0 between pieces), shard: dealt out in turn."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Words] = {}
        for lang, texts in clean_texts(batches):
            words = own.get(lang) or own.setdefault(lang, Words(lang))
            at = words.places(texts)
            # Rows end between pieces, so no phrase is cut, after ROW words or more.
            edges = np.flatnonzero(at == 0) + 1
            ends = edges[np.unique(np.minimum(np.searchsorted(edges, np.arange(ROW, len(at) + ROW, ROW)), len(edges) - 1))]
            numbers = words.numbers[at].astype(np.uint32)
            rows_ = [numbers[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.binary())], names=["numbers"])

    return rows.mapInArrow(number, "numbers binary").withColumn("shard", F.expr(f"cast(monotonically_increasing_id() % {SHARDS} as int)"))


def scan(shard: DataFrame, words_open: bool, filter_: Filter | None) -> DataFrame:
    """h, n: the numbers of words and phrases that a scan of a shard counts, added up run by run."""
    sent = shard.sparkSession.sparkContext.broadcast(filter_)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, n = [], 0
        for batch in batches:
            for x in batch.column("numbers").to_pylist():
                held.append(np.frombuffer(x, np.uint32))
                n += len(held[-1])
                if n >= TOKENS:
                    yield np.concatenate(held).astype(np.uint64)
                    held, n = [], 0
        if held:
            yield np.concatenate(held).astype(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches):
            found = []
            if words_open:
                found.append(counted(of_words(x[x > 0])))
            if sent.value:
                found += (counted(longer) for _, _, longer in known_phrases(x, sent.value, True))
            for h, n in found:
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return shard.select("numbers").mapInArrow(count, "h long, n long")


def frequent_numbers(shards: DataFrame, least: int) -> DataFrame:
    """h, at: the numbers of words and phrases of up to LONGEST words with `least` occurrences or more, and the scan after which
    they had reached it. A saved table.

    What each scan counts is saved as it comes, and after a scan the counts of the last SHARDS scans are added up: every
    shard once. A phrase is open in the SHARDS scans after the one in which the later of its subphrases reached the
    threshold; after the last of them its whole count has been seen.
    """
    deltas: list[DataFrame] = []
    reached = saved(shards.sparkSession.createDataFrame([], "h long, at int"), "reached")
    filter_, step = None, 0
    while True:
        deltas.append(saved(scan(shards.where(F.col("shard") == step % SHARDS), step < SHARDS, filter_), "counts"))
        if len(deltas) > SHARDS:
            discard(deltas.pop(0))
        cycle = deltas[0]
        for d in deltas[1:]:
            cycle = cycle.unionByName(d)
        likely = cycle.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        before = reached
        reached = saved(before.unionByName(likely.join(before, "h", "left_anti").select("h", F.lit(step).alias("at"))), "reached")
        discard(before)
        step += 1
        parts = reached.where(f"h & 3 < {LONGEST - 1}").withColumn("lately", F.col("at") >= step - SHARDS)
        many, late = parts.agg(F.count(F.lit(1)), F.count_if("lately")).first()
        if step >= SHARDS and not late:
            break
        filter_ = number_filter(parts, many)
    discard(*deltas)
    return reached


def named_counts(rows: DataFrame, filter_: Filter) -> DataFrame:
    """lang, m, phrase, n: phrases whose numbers are in the filter, counted by their words; with m = 0, all words."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Words] = {}
        for lang, texts in clean_texts(batches):
            words = own.get(lang) or own.setdefault(lang, Words(lang))
            at = words.places(texts)
            many = np.bincount(at, minlength=len(words.names))
            names = pa.array(words.names, pa.binary())
            i = np.flatnonzero(in_filter(sent.value, of_words(words.numbers))[0] & (many > 0))
            i = i[i > 0]
            found = [(0, pa.array([b""], pa.binary()), many[1:].sum(keepdims=True)), (1, names.take(pa.array(i)), many[i])]
            code, size = at, len(words.names)
            for m, places, longer in known_phrases(words.numbers[at], sent.value, False):
                # Told apart by their words: by the number of the front in this batch and the last word.
                places = places[in_filter(sent.value, longer)[0]]
                _, first, own_code, n = np.unique(code[places] * size + at[places + m - 1], return_index=True, return_inverse=True, return_counts=True)
                p = places[first]
                found.append((m, pa.compute.binary_join_element_wise(*(names.take(pa.array(at[p + j])) for j in range(m)), b" "), n))
                code = np.zeros(len(at), np.int64)
                code[places] = own_code
            for m, phrases, n in found:
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), m, np.int32)), phrases, pa.array(n, pa.int64())],
                    names=["lang", "m", "phrase", "n"])

    return rows.mapInArrow(count, "lang string, m int, phrase binary, n long")


def frequent_phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Words and phrases of up to LONGEST words with `least` occurrences or more in their language: lang, m, phrase (binary),
    n; and the occurrences of all words of each language: lang, n. Saved tables."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    shards = saved(number_shards(rows), "shards", "shard")
    numbers = frequent_numbers(shards, least)
    discard(shards)
    filter_ = number_filter(numbers.withColumn("lately", F.lit(False)), numbers.count())
    named = saved(named_counts(rows, filter_).groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")).where(f"n >= {least} or m = 0"), "named")
    discard(numbers)
    return named.where("m > 0"), named.where("m = 0 and n > 0").select("lang", "n")


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to LONGEST words.

    Words are what spaces and tabs separate within the pieces that `.,;:!?` and line ends leave, A-Z lower-cased. Null and
    empty texts have none; a null lang is `und`; a text of any length is read whole and repeated rows count as often as they
    stand there. a counts a phrase's occurrences, overlapping ones too; phrases with fewer than `least` are none. A cut after the
    first k words gives l and r, the occurrences of both parts, and floor(2000000 a / (l + r)); the lowest score counts, of
    equal ones that of the smallest k. Phrases within a longer one that occurs `covered` percent as often are left out. Order: score,
    a (both descending), phrase (by its UTF-8 bytes). An empty table gives an empty one.
    """
    found, totals = frequent_phrases(docs, least, text, lang)
    found = found.select("lang", "m", F.col("phrase").cast("string").alias("phrase"), "n")
    split = found.where("m > 1").select("lang", "m", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    def part(first, length) -> Column:
        return F.array_join(F.slice("words", first, length), " ")

    cuts = split.select("lang", "m", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("front"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("back"))
    known = found.select("lang", "phrase", "n")
    cuts = cuts.join(known.withColumnsRenamed({"phrase": "front", "n": "l"}), ["lang", "front"]).join(
        known.withColumnsRenamed({"phrase": "back", "n": "r"}), ["lang", "back"])
    score = F.expr("(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = split.where("m > 2").select("lang", "m", "a", "words", F.explode(F.expr("sequence(2, m - 1)")).alias("size")).select(
        "lang", "a", "words", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("at")).select("lang", "a", part(F.col("at"), F.col("size")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.expr("cast(longer as decimal(20, 0)) * 100") < F.expr(f"cast(a as decimal(20, 0)) * {covered}")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
