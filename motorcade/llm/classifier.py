"""Quality classifier by ordinal cumulative-link regression.

Graded ratings 0 to 3 come from two labels: 2 * quality + (1 - toxic), where any quality or toxic above 0 counts as 1. One weight vector over hashed text features is
shared by all grades, and ordered thresholds cut its score: P(grade > k) = logistic(score - threshold k). The expected
grade and the tail probability P(grade >= GOOD) are the results.

Features are means over a text's words: hashed words, word shapes (letters, digits, case, marks, symbols), and bins of
the share of different words and of the length. Sums over whole texts, so memory follows the longest text.

The fit reads at most MAX_FIT labelled rows, those of smallest hash of the id, whose feature sums, at most some
thousands for each, come to the driver; the likelihood is climbed by L-BFGS until its slope is TOLERANCE.

Edge cases: a null, empty or blank text has the features of length 0 only; without labels, or with one grade, the
thresholds follow the counts alone; rows with a null label aren't learnt from; repeated rows are rated alike; only
id, text and the two labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorcade.llm import kernels as K
from motorcade.llm.common import bounded, dropped, written

BITS = 13
SHAPES = 64
BINS = 24
SIZE = (1 << BITS) + SHAPES + BINS
MAX_FIT = 6000
GRADES = 4
GOOD = 2
#: Tail probability under which a document isn't kept.
KEEP_AT = 0.1
TOLERANCE = 1e-4
RIDGE = 2e-4
SHAPE_GAIN, WORD_GAIN, BIN_GAIN = 4.0, 8.0, 1.0

_FLAG = np.zeros(256, np.uint8)
_FLAG[ord("a") : ord("z") + 1] = 1
_FLAG[ord("A") : ord("Z") + 1] = 2
_FLAG[ord("0") : ord("9") + 1] = 4
_FLAG[list(b"!?")] = 8
_FLAG[list(b"#*$%&|<>@=~^{}[]\\")] = 16
_FLAG[128:] = 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of a slice, a feature of a document once or more."""
    docs = len(off) - 1
    w = K.Words(data, off, True)
    n = np.maximum(w.count, 1)
    # reduceat runs to the next start; only spaces lie between, which have no flag
    shape = np.bitwise_or.reduceat(_FLAG[data], w.start).astype(np.int64) if len(w.start) else np.zeros(0, np.int64)
    keys = np.unique(K.chain([w.hash, w.doc.astype(np.uint64)]), return_index=True)[1] if len(w.hash) else np.zeros(0, np.int64)
    different = np.bincount(w.doc[keys], minlength=docs)
    share = np.minimum(7, (8 * different / n).astype(np.int64))
    length = np.minimum(15, np.log2(w.count + 1).astype(np.int64))
    base = 1 << BITS
    doc = np.concatenate([w.doc, w.doc, np.arange(docs), np.arange(docs)])
    feature = np.concatenate([(w.hash >> np.uint64(64 - BITS)).astype(np.int64), base + shape, base + SHAPES + share, base + SHAPES + 8 + length])
    value = np.concatenate([WORD_GAIN / n[w.doc], SHAPE_GAIN / n[w.doc], np.full(2 * docs, BIN_GAIN)])
    return doc, feature, value


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_FIT) -> OrdinalModel:
    good = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    rated = good.groupBy(id_col).agg(F.max(F.when(F.col("quality") > 0, 2).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)).cast("int").alias("grade"))
    picked = written(rated.orderBy(F.xxhash64(id_col), id_col).limit(most), "rated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grade = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in K.slices(b.column(1)):
                doc, feature, value = features(data, off)
                key, back = np.unique(doc * SIZE + feature, return_inverse=True)
                total = np.bincount(back, value)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) * SIZE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grade[lo:hi], pa.int32()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key % SIZE, pa.int32())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(total, pa.float32()))],
                    ["grade", "f", "v"],
                )

    rows = bounded(docs).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    got = rows.orderBy(id_col, "text").select("grade", "text").mapInArrow(run, "grade int, f array<int>, v array<float>").toArrow()
    dropped(picked)
    y = got["grade"].to_numpy().astype(np.int64)
    f = got["f"].combine_chunks() if got.num_rows else None
    if not len(y):
        return OrdinalModel(np.zeros(SIZE), np.arange(GRADES - 1) - (GRADES - 2) / 2)
    length = np.array([len(x) for x in f])
    return train(np.repeat(np.arange(len(y)), length), f.flatten().to_numpy(), got["v"].combine_chunks().flatten().to_numpy(), y)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from a first one and logarithms of gaps."""
    return np.concatenate([[free[0]], free[0] + np.cumsum(np.exp(free[1:]))])


def loss(x: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with ridge, and its gradient, at weights followed by free thresholds."""
    n, w, free = len(y), x[:SIZE], x[SIZE:]
    t = thresholds(free)
    s = np.bincount(row, value * w[feature], minlength=n)
    above = _logistic(s[:, None] - t)  # P(grade > k)
    full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
    p = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-12)
    slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
    ds = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / p / n
    dt = np.array([((y == k + 1) * slope[:, k + 1] / p - (y == k) * slope[:, k + 1] / p).sum() / n for k in range(GRADES - 1)])
    dfree = [dt.sum(), *[dt[k + 1 :].sum() * np.exp(free[k + 1]) for k in range(GRADES - 2)]]
    grad = np.concatenate([np.bincount(feature, value * ds[row], minlength=SIZE) + RIDGE * w, dfree])
    return float(-np.log(p).mean() + RIDGE / 2 * w @ w), grad


def train(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray) -> OrdinalModel:
    """Maximum likelihood with ridge, from thresholds that follow the counts."""
    n = len(y)
    share = np.clip([(y > k).mean() for k in range(GRADES - 1)], 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    cut = -np.log(share / (1 - share))
    x = np.concatenate([np.zeros(SIZE), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    now, grad = loss(x, row, feature, value, y)
    while np.abs(grad).max() > TOLERANCE:
        way, kept = grad.copy(), []
        for s, g in reversed(pairs):
            kept.append((s @ way) / (s @ g))
            way -= kept[-1] * g
        if pairs:
            s, g = pairs[-1]
            way *= (s @ g) / (g @ g)
        for (s, g), a in zip(pairs, reversed(kept), strict=True):
            way += (a - (g @ way) / (s @ g)) * s
        size = 1.0 if pairs else min(1.0, 1 / np.abs(grad).max())
        while True:
            new, slope = loss(x - size * way, row, feature, value, y)
            if new <= now - 1e-4 * size * (way @ grad) or size < 1e-8:
                break
            size /= 2
        step, turn = -size * way, slope - grad
        if size < 1e-8 or now - new <= 1e-9 * abs(now):  # as far as rounding lets it go
            break
        if step @ turn > 1e-12:
            pairs = [*pairs[-9:], (step, turn)]
        x, now, grad = x + step, new, slope
    return OrdinalModel(x[:SIZE], thresholds(x[SIZE:]))


def rate(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_grade (0 to 3), tail (P(grade >= GOOD)), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in K.slices(b.column(1)):
                doc, feature, value = features(data, off)
                above = _logistic(np.bincount(doc, value * model.weights[feature], minlength=hi - lo)[:, None] - model.thresholds)
                tail = above[:, GOOD - 1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(above.sum(1)), pa.array(tail), pa.array(tail >= KEEP_AT)], [id_col, "expected_grade", "tail", "kept"])

    return bounded(df).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, expected_grade double, tail double, kept boolean")
