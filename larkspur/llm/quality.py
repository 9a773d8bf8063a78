"""Quality classifier: regularised quadratic discriminant over transformed statistics of each document.

``features`` reads a text once and gives ``STATS`` numbers of fixed meaning
(sizes on a log scale, shares on a square-root scale).  ``fit`` sums first and
second moments per class over all labelled rows in Spark, shrinks each class
covariance towards the pooled one and towards a multiple of the identity, and
caches the Cholesky factors; ``score`` is the logistic function of the
difference of the log densities (Mahalanobis distances and log determinants)
plus that of the log priors.

Null texts count as empty; empty texts have all-zero statistics and get a score
like any other.  Texts may be of any length.  Without labels of both classes
the score is the share of label 1 (0.5 without any).  Rows of one id teach and are
scored each on their own; equal texts have equal scores, and a score of one half
counts as label 1.  Only the columns named are read, so others may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import SPACE, flat, mix, padded, span_hashes, text_chunks, word_spans

#: Byte classes whose shares are statistics.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
_NAMES = ("lower", "upper", "digit", "space", "line", "point", "mark", "symbol", "wide")
STATS = ("log_bytes", "log_words", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "pair_repeats", "log_line", "line_repeats", *_NAMES)
D = len(STATS)
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02

_LINES = np.zeros(256, bool)
_LINES[10] = True


def _distinct(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each document's slice."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=len(offsets) - 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    offsets, data = flat(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10)[:, 1:]
    buf = padded(data)
    s, e, w = word_spans(offsets, data, SPACE)
    length = (e - s).astype(float)
    words = np.diff(w).astype(float)
    of = np.repeat(np.arange(n), np.diff(w))
    per = lambda v: np.bincount(of, v, minlength=n)
    h = span_hashes(buf, s, e - s)
    ls, le, lw = word_spans(offsets, data, _LINES)
    lines = np.diff(lw).astype(float)
    one = np.maximum(words, 1)
    mean = per(length) / one
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    inner = of[:-1] == of[1:]
    pairs = np.bincount(of[:-1][inner], minlength=n)
    pair_offsets = np.concatenate([[0], np.cumsum(pairs)])
    out = np.column_stack([
        np.log1p(size),
        np.log1p(words),
        np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(per(length**2) / one - mean**2, 0))),
        np.sqrt(per(length <= 3) / one),
        np.sqrt(per(length >= 12) / one),
        np.sqrt(_distinct(h, w) / one),
        np.sqrt(1 - _distinct(pair[inner], pair_offsets) / np.maximum(pairs, 1)) * (pairs > 0),
        np.log1p(size / np.maximum(lines, 1)),
        np.sqrt(1 - _distinct(span_hashes(buf, ls, le - ls), lw) / np.maximum(lines, 1)) * (lines > 0),
        np.sqrt(classes / np.maximum(size, 1)[:, None]),
    ])
    return out


def features(df: DataFrame, keep: list[str], text: str = "text", out: str = "stats") -> DataFrame:
    """The columns ``keep`` and an array of STATS."""
    src = df.select(*keep, text)
    schema = df.select(*keep, F.array(F.lit(0.0)).alias(out)).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            x = statistics(batch.column(text))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), rows], names=[*keep, out])

    return src.mapInArrow(read, schema)


@dataclass
class Model:
    prior: np.ndarray
    mean: np.ndarray | None = None
    factor: np.ndarray | None = None  #: inverse Cholesky factors, one per class
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior[1])
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.mean, self.factor, self.log_det, strict=True)]
        odds = density[1] - density[0] + np.log(self.prior[1]) - np.log(self.prior[0])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def solve(count: np.ndarray, first: np.ndarray, second: np.ndarray) -> Model:
    """From counts, sums and sums of outer products of the two classes."""
    if (count < 2).any():
        return Model(np.array([1 - (p := count[1] / count.sum() if count.sum() else 0.5), p]))
    mean = first / count[:, None]
    own = second / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = np.einsum("k,kij->ij", count / count.sum(), own)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-8))
    factor, log_det = [], []
    for c in own:
        c = (1 - SHRINK_POOLED - SHRINK_IDENTITY) * c + SHRINK_POOLED * pooled + SHRINK_IDENTITY * scale
        low = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Model(count / count.sum(), mean, np.array(factor), np.array(log_det))


def fit(stats: DataFrame, label: str = "quality", column: str = "stats") -> Model:
    """Moments over every row with label 0 or 1: each task sends two sums of fixed size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.array(batch.column(label).to_pylist())
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            for k in (0, 1):
                v = x[y == k]
                total[k] += np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], total.shape[1])), pa.array(np.tile(np.arange(total.shape[1]), 2)), pa.array(total.ravel())], names=["k", "j", "v"])

    rows = stats.where(F.col(label).isin(0, 1) & F.col(column).isNotNull()).select(label, column)
    total = np.zeros((2, 1 + D + D * D))
    for r in rows.mapInArrow(sums, "k long, j long, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).collect():
        total[r["k"], r["j"]] = r["v"]
    return solve(total[:, 0], total[:, 1 : 1 + D], total[:, 1 + D :].reshape(2, D, D))


def score(stats: DataFrame, model: Model, column: str = "stats", out: str = "score") -> DataFrame:
    """Replaces the statistics by the score."""
    rest = stats.drop(column, out)
    schema, names = rest.select("*", F.lit(0.0).alias(out)).schema, rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(model.score(x))], names=[*names, out])

    return stats.mapInArrow(run, schema)
