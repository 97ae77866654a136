"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = logistic(x . w - threshold_k): one weight per hashed feature shared by all grades, and ordered thresholds.
x is the mean over a text's words of two hashed features per word: the word itself, and its shape with what it repeats.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory, saved, slices, small_batches, with_fields
from .toxicity import labelled_sample

BUCKETS = 1 << 16
#: Words a worker remembers before it starts anew; changes no result.
REMEMBERED = 100_000
_RUNS = re.compile(r"(.)\1+")
_SHAPE = {**{c: "a" for c in range(97, 123)}, **{c: "A" for c in range(65, 91)}, **{c: "0" for c in range(48, 58)}}
_known: dict[str, tuple[int, int, int]] = memory()


def shape_of(word: str) -> str:
    """Runs of lower letters, capitals and digits as a, A and 0; letters beyond ASCII by case; signs as they are."""
    marked = "".join(c if ord(c) < 128 else "A" if c.isupper() else "a" if c.isalpha() else c for c in word.translate(_SHAPE))
    return _RUNS.sub(r"\1", marked)[:12]


def features(text: str | None) -> list[int]:
    """Buckets of a text: two for each word, none for a text without words."""
    out: list[int] = []
    previous = None
    for word in (text or "").split():
        got = _known.get(word)
        if got is None:
            if len(_known) >= REMEMBERED:
                _known.clear()
            shape = shape_of(word)
            got = _known[word] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in ("w " + word.lower(), "s " + shape, "r " + shape))
        out.append(got[0])
        out.append(got[2] if word == previous else got[1])
        previous = word
    return out


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k: one row per text, falling along the row."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -50, 50)))

    def signal(self, text: str | None) -> float:
        ids = features(text)
        return float(self.weights[ids].mean() * 2) if ids else 0.0


def learn_quality(docs: DataFrame, labels: DataFrame, grade=None, max_rows: int = 8_000, steps: int = 150) -> OrdinalModel:
    """Fit on a bounded sample: at most `max_rows` labelled rows that are not held out (see labelled_sample).

    grade: an integer rating from 0 over the columns of labels; by default 0 for poor, 1 for good but toxic, 2 for good
    rows. Grades that no row has get no threshold of their own; with one grade only, every text is expected to have it.
    """
    grade = F.expr("quality * (2 - coalesce(toxic, 0))") if grade is None else grade
    sample = saved(labelled_sample(docs, labels, grade.cast("int"), max_rows), "quality_sample")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, shares = [], []
            for text in batch.column("text").to_pylist():
                found = np.array(features(text), np.int64)
                own, n = np.unique(found, return_counts=True)
                ids.append(own.astype(np.int32))
                shares.append((n / max(1, len(found)) * 2).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["label", "ids", "shares"])

    rows = sample.select("text", "label").mapInArrow(hashed, "label int, ids array<int>, shares array<float>").toArrow()
    y = rows.column("label").to_numpy()
    if not len(y):
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.zeros(1))
    ids, shares = rows.column("ids").combine_chunks(), rows.column("shares").combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(ids.offsets.to_numpy()))
    return fit_ordinal(row, ids.flatten().to_numpy(), shares.flatten().to_numpy(), y, steps)


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood, with ordered thresholds as a first one and positive gaps."""
    grades = int(y.max())
    if grades == 0:
        return OrdinalModel(np.zeros(BUCKETS, np.float32), np.array([50.0]))
    above = np.stack([(y > k) for k in range(grades)], 1).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    w = np.zeros(BUCKETS)
    m, v = np.zeros(BUCKETS + grades), np.zeros(BUCKETS + grades)
    for t in range(1, steps + 1):
        cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
        z = np.bincount(row, w[col] * value, minlength=len(y))
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -50, 50)))
        # P(y = k) is the difference of neighbouring tails; its log-likelihood by z and by each threshold.
        padded = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], 1)
        slope = padded * (1 - padded)
        at = np.arange(len(y))
        p = np.maximum(padded[at, y] - padded[at, y + 1], 1e-9)
        dz = (slope[at, y] - slope[at, y + 1]) / p
        dcut = np.zeros(grades)
        for k in range(grades):
            dcut[k] = (-(slope[:, k + 1] / p)[y == k + 1].sum() + (slope[:, k + 1] / p)[y == k].sum()) / len(y)
        dtheta = np.concatenate([[dcut.sum()], [dcut[k:].sum() * np.exp(theta[k]) for k in range(1, grades)]])
        g = -np.concatenate([np.bincount(col, dz[row] * value, minlength=BUCKETS) / len(y) - 1e-6 * w, dtheta])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w -= move[:BUCKETS]
        theta -= 0.1 * move[BUCKETS:]
    cuts = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    return OrdinalModel(w.astype(np.float32), cuts)


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Add expected_grade double and tails array<double>, P(grade > k) for k = 0, 1, ..., from the whole text.

    Null texts and texts without words have the signal 0, so the thresholds alone decide. Repeated rows give repeated
    results, empty tables empty ones; columns of the same names are replaced. No shuffle; only the weights are sent.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("expected_grade", "tails")]
    schema = with_fields(docs.select(*kept), "expected_grade double, tails array<double>")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*sent.value)
        for batch in slices(batches, text):
            tails = own.tails(np.array([own.signal(x) for x in batch.column(text).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))],
                names=[*kept, "expected_grade", "tails"])

    return docs.select(*kept).mapInArrow(run, schema)


def accepted(least: float = 0.5, above: int = 0):
    """Rows to keep: those whose probability of a grade over `above` is `least` or more."""
    return F.col("tails")[above] >= least
