"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters, invisible characters), an Aho-Corasick
automaton finds lexicon words and exception phrases in one pass, hits inside an exception phrase do not count, and the
weighted sum of the rest is divided by a power of the text's length. Weights are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, with_fields

#: Letters of other scripts by the Latin letter that they look like.
HOMOGLYPHS = {
    "a": "аɑαａ", "b": "вЬβｂ", "c": "сϲｃ", "d": "ԁɗｄ", "e": "еєεｅ", "f": "ƒｆ", "g": "ɡｇ", "h": "һнｈ", "i": "іιıｉ",
    "j": "јｊ", "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "ոηｎ", "o": "оοσօｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ",
    "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ",
}
#: Digits by the letter that they stand for, and l with them, as 1 stands for either i or l.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
#: Signs stand for letters only where a letter or digit follows, not as punctuation.
SIGNS = {"@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = str.maketrans(
    {g: DIGITS.get(letter, letter) for letter, gs in HOMOGLYPHS.items() for g in gs} | DIGITS | dict.fromkeys(INVISIBLE)
)
_SIGN = re.compile(r"(?<![@$!])[@$!](?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")
#: A word counts so many times in one text at most.
MOST_PER_WORD = 3


def fold(text: str | None) -> str:
    low = (text or "").lower()
    return _SIGN.sub(lambda m: SIGNS[m[0]], low).translate(_TABLE)


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    bias: float = -2.0
    #: The sum is divided by (words / 100) to this power, texts of fewer words counting as 100.
    power: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for word in self.weights:
            machine.add_word(word, (word, False))
        for phrase in self.exceptions:
            machine.add_word(phrase, (phrase, True))
        if len(machine):
            machine.make_automaton()
        return machine


def matches(machine: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, str]]:
    """Whole-word hits (start, end, word) outside exception phrases."""
    found, covered = [], []
    if not len(machine):
        return found
    for last, (word, exception) in machine.iter(folded):
        start, end = last + 1 - len(word), last + 1
        if (start and folded[start - 1].isalnum()) or (end < len(folded) and folded[end].isalnum()):
            continue
        (covered if exception else found).append((start, end, word))
    if covered:
        found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _ in covered)]
    return found


def words_in(folded: str) -> int:
    return folded.count(" ") + folded.count("\n") + 1 if folded else 0


def scored(lexicon: Lexicon, machine: ahocorasick.Automaton, text: str | None) -> tuple[float, list[str]]:
    folded = fold(text)
    counts = Counter(word for _, _, word in matches(machine, folded))
    total = sum(lexicon.weights[w] * min(n, MOST_PER_WORD) for w, n in counts.items())
    z = lexicon.bias + total / max(1.0, words_in(folded) / 100) ** lexicon.power
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50)))), sorted(counts)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add toxicity double (0 to 1) and toxic_words array<string> (folded) from the whole text of every row.

    Null and empty texts have no words and get the lexicon's lowest score. Repeated rows give repeated results, empty
    tables empty ones; columns of the same names are replaced. No shuffle; only the lexicon is sent.
    """
    kept = [c for c in docs.columns if c not in ("toxicity", "toxic_words")]
    schema = with_fields(docs.select(*kept), "toxicity double, toxic_words array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in slices(batches, text):
            rows = [scored(lexicon, machine, x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([r[0] for r in rows], pa.float64()),
                pa.array([r[1] for r in rows], pa.list_(pa.string())),
            ], names=[*kept, "toxicity", "toxic_words"])

    return docs.select(*kept).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label, max_rows: int) -> DataFrame:
    """Distinct texts (at most max_rows labelled rows, chosen by a hash of the id) with `label`, an expression over labels.

    Rows whose crc32(doc_id) mod 5 is 0 are held out, as are null ids, texts and labels; of labels that differ for one
    id or text the largest holds.
    """
    chosen = (
        labels.select("doc_id", label.alias("label")).where("label is not null and crc32(cast(doc_id as string)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # At most max_rows pairs of numbers: a proven bound.
    joined = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy(F.sha2("text", 256).alias("h")).agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_words: int = 400, least: int = 5) -> Lexicon:
    """Learn words, weights, exceptions, bias and length power from labelled rows.

    The fit uses a bounded sample: at most `max_rows` labelled rows that are not held out, of which `max_words` candidate
    words (in `least` toxic texts or more) are taken by log-odds. Without toxic or without clean rows, the lexicon is empty.
    """
    sample = saved(labelled_sample(docs, labels, F.col("toxic"), max_rows), "toxic_sample")
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, bias=5.0 if toxic else -5.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for word in set(_WORD.findall(fold(text))):
                    seen[word][label] += 1
            yield pa.RecordBatch.from_pydict({"word": list(seen), "clean": [x[0] for x in seen.values()], "toxic": [x[1] for x in seen.values()]},
                                             schema=pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic) / ((F.col("clean") + 0.5) / F.lit(clean)))
    candidates = [
        r[0] for r in sample.select("text", "label").mapInArrow(count, "word string, clean long, toxic long").groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where((F.col("toxic") >= least) & (odds > 1.5))
        .orderBy((odds * F.sqrt("toxic")).desc(), "word").limit(max_words).collect()
    ]
    if not candidates:
        return Lexicon({}, bias=float(np.log(toxic / clean)))
    machine = Lexicon(dict.fromkeys(candidates, 1.0)).automaton()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                # All hits of a text; of equal ones (word and neighbours) no more than MOST_PER_WORD can count.
                hits: Counter = Counter()
                for start, end, word in matches(machine, folded):
                    before = re.search(r"[^\W_]+[ \n]$", folded[max(0, start - 30):start])
                    after = re.match(r"[ \n][^\W_]{1,30}(?![^\W_])", folded[end:end + 32])
                    hits[word, (before[0] if before else "") + word, word + (after[0] if after else "")] += 1
                rows.append((words_in(folded), [list(h) for h, n in hits.items() for _ in range(min(n, MOST_PER_WORD))]))
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.string()))),
            ], names=["label", "words", "hits"])

    rows = sample.select("text", "label").mapInArrow(contexts, "label int, words long, hits array<array<string>>").collect()
    # Phrases of a candidate and a neighbour that clean texts hold far more often than toxic ones.
    phrases: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for label, _, hits in rows:
        for phrase in {p for word, *own in hits for p in own if p != word}:
            phrases[phrase][label] += 1
    exceptions = {p for p, (c, t) in phrases.items() if c >= 3 and c * toxic >= 4 * t * clean}
    place = {w: i for i, w in enumerate(candidates)}
    x = np.zeros((len(rows), len(candidates)), np.float32)
    for i, (_, _, hits) in enumerate(rows):
        for word, *own in hits:
            x[i, place[word]] += not exceptions.intersection(own)
    x = np.minimum(x, MOST_PER_WORD)
    y = np.array([r[0] for r in rows], np.float32)
    length = np.maximum(1, np.array([r[1] for r in rows]) / 100)
    best = None
    for power in (0.0, 0.15, 0.3):
        loss, weights, bias = fit_weights(x / (length ** power).astype(np.float32)[:, None], y)
        if best is None or loss < best[0]:
            best = (loss, weights, bias, power)
    _, weights, bias, power = best
    return Lexicon({w: float(weights[i]) for w, i in place.items() if weights[i] > 0.05}, exceptions, float(bias), power)


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 400, shrink: float = 4e-4) -> tuple[float, np.ndarray, float]:
    """Logistic regression with weights of 0 or more, shrunk towards 0, by proximal steps: loss, weights, bias."""
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rate, moment = 0.5, np.zeros_like(w)
    scale = 1 / np.sqrt(np.maximum((x ** 2).mean(0), 1e-3))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        grad = x.T @ (p - y) / len(y)
        moment = 0.8 * moment + grad
        w = np.maximum(0, w - rate * scale * moment - rate * shrink).astype(np.float32)
        b -= rate * float((p - y).mean())
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), w, b
