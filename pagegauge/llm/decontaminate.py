"""Benchmark decontamination by winnowing.

Texts are word sequences. Of every window of consecutive k-gram hashes the smallest is kept; a span of k-1 words more
than the window holds a whole window in both texts, so both keep one and the same fingerprint of it. Fingerprints shared
with the benchmark are then extended to every shared window of `size` words around them and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, with_fields

#: Words of a shared window (shorter items: the whole item), and words of a k-gram.
SIZE, GRAM = 13, 5
#: A block of the benchmark that is sent to the executors holds about so many characters; more blocks, more passes.
BLOCK_CHARS = 32_000_000
#: Words are the runs of 0-9, a-z and everything beyond ASCII after lower-casing A-Z; UTF-8's longer forms are all beyond.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    for i in range(n):
        h = (h ^ x[i:i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash of each window."""
    if window == 1 or len(hashes) < window:
        return hashes if window == 1 else hashes[:0]
    n = len(hashes) - window + 1
    low = hashes[:n]
    for i in range(1, window):
        low = np.minimum(low, hashes[i:i + n])
    return low


class Index:
    """Windows of a block of the benchmark: fingerprints to look up, windows to confirm them, items of each window."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = SIZE, gram: int = GRAM) -> None:
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(ids[i:i + n]), set()).add(item)
        #: For each window length: k, window of hashes, fingerprints, window hashes (sorted), their words, their items.
        self.parts = []
        for n, found in sorted(by_length.items()):
            k = min(gram, n) if n == size else n
            words = np.array(list(found), np.int64).reshape(-1, n)
            whole = grams(words.ravel(), n)[::n]
            order = np.argsort(whole, kind="stable")
            rows = [winnow(grams(row, k), n - k + 1) for row in words]
            owners = [tuple(x) for x in found.values()]
            self.parts.append((n, k, np.unique(np.concatenate(rows)), whole[order], words[order], [owners[i] for i in order]))

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
        """Per text: its words, the hit intervals [start, end) of words, the items with a window in it."""
        get = self.vocabulary.get
        ids: list[int] = []
        starts, counts = [], []
        for text in texts:
            words = words_of(text)
            starts.append(len(ids))
            counts.append(len(words))
            ids += [get(w, -1) for w in words]
            ids.append(-1)  # no window reaches from one text into the next
        flat = np.array(ids, np.int64)
        hit = np.zeros(len(flat) + 1, np.int32)
        items: dict[int, set[int]] = {}
        bounds = np.array(starts, np.int64)
        for n, k, prints, whole, words, owners in self.parts:
            low = winnow(grams(flat, k), n - k + 1)
            if not len(low):
                continue
            at = np.minimum(np.searchsorted(prints, low), len(prints) - 1)
            # A window of words that shares its fingerprint; extending to the neighbours happens by testing each of them.
            at = np.flatnonzero(prints[at] == low)
            if not len(at):
                continue
            there = flat[at[:, None] + np.arange(n)]
            at, there = at[(there >= 0).all(1)], there[(there >= 0).all(1)]
            own = grams(there.ravel(), n)[::n] if len(at) else np.empty(0, np.uint64)
            place = np.searchsorted(whole, own)
            for i, p in enumerate(place.tolist()):
                while p < len(whole) and whole[p] == own[i]:
                    if (words[p] == there[i]).all():
                        hit[at[i]] += 1
                        hit[at[i] + n] -= 1
                        items.setdefault(int(np.searchsorted(bounds, at[i], "right")) - 1, set()).update(owners[p])
                        break
                    p += 1
        inside = np.concatenate([[0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(inside))
        spans: dict[int, list[tuple[int, int]]] = {}
        for start, end in edges.reshape(-1, 2).tolist():
            d = int(np.searchsorted(bounds, start, "right")) - 1
            spans.setdefault(d, []).append((start - starts[d], end - starts[d]))
        return [(n, spans.get(d, []), sorted(items.get(d, ()))) for d, n in enumerate(counts)]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, chars: int) -> list[list]:
    """The benchmark's rows as lists for the driver to send, each of about `chars` characters (or one longer item)."""
    blocks, size = [[]], 0
    for row in benchmark.select(item_id, text).where(F.col(item_id).isNotNull() & (F.length(text) > 0)).toLocalIterator():
        if size and size + len(row[1]) > chars:
            blocks.append([])
            size = 0
        blocks[-1].append((row[0], row[1]))
        size += len(row[1])
    return blocks


def find_shared(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                item_text: str = "text", size: int = SIZE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add to every document n_words, n_hit, items array<long> (sorted) and hits array<struct<start, end>> in words.

    Hits are exact: a word is hit if it lies in an occurrence of `size` consecutive words of an item, or of a whole
    shorter item. Null and empty texts have no words. Items without id or words match nothing; repeated items and rows
    count alike; an empty benchmark hits nothing. The columns added replace ones of the same names.

    Documents are neither shuffled nor joined by Spark: a block of the benchmark, bounded by `block_chars`, goes to the
    executors with its fingerprints. A larger benchmark takes several blocks: each batch of documents is held against
    each of them, and hits are united per document, so results do not depend on the blocks.
    """
    small_batches(docs.sparkSession)
    added = ("n_words", "n_hit", "items", "hits")
    kept = [c for c in docs.columns if c not in added]
    schema = with_fields(docs.select(*kept), "n_words long, n_hit long, items array<long>, hits array<struct<start:long,end:long>>")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in blocks_of(benchmark, item_id, item_text, block_chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = Index(sent[0].value, size) if len(sent) == 1 else None
        for batch in slices(batches, text, 4 << 20 if single else 64 << 20):
            texts = batch.column(text).to_pylist()
            found = [(single or Index(block.value, size)).hits(texts) for block in sent]
            rows = [united([f[i] for f in found]) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sum(e - s for s, e in r[1]) for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                pa.array([[{"start": s, "end": e} for s, e in r[1]] for r in rows], span),
            ], names=[*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def united(found: list[tuple]) -> tuple:
    """One document's hits in several blocks as one."""
    if len(found) == 1:
        return found[0]
    spans: list[tuple[int, int]] = []
    for s, e in sorted(x for _, own, _ in found for x in own):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return found[0][0], spans, sorted({x for _, _, items in found for x in items})


def contaminated():
    """The rule of a contaminated document: hits of a twentieth of its words at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
