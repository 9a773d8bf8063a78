"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic examples against unlabelled text.

Words are lower-case runs of ASCII letters and digits and bytes above 127.  A
word has a place in each of ``HASHES`` rows of ``BUCKETS`` counters; one pass
over all training texts counts, for each counter, the documents and the confirmed
toxic documents that have a word there.  The evidence of a counter is how much
commoner it is in confirmed examples than in all text (a log ratio from the
cautious ends of both counts, at least 0); that of a word is the median of its
counters, so two words rarely pass for each other.  A text's statistics are
its three strongest words, the sum of evidence and the number and share of strong
words, each on a coarse grid (``LEVELS``): training texts are summed up by a
histogram of 552,960 cells at most, whatever their number.

``train`` fits a logistic classifier to the histogram in numpy by the risk
  prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]):
the unlabelled part, corrected by the class prior, can't fall below zero, and a
step that would push it there goes the other way.  Statistics of confirmed
examples leave themselves out of the counts, so a rare word of one toxic text
is no evidence.  Texts labelled 0 tell the class prior only: the share of label 1
among training labels (``PRIOR`` if no text is labelled 0).

At most ``POSITIVES`` confirmed examples, those with the smallest hash of their id,
teach; all training texts count as unlabelled.  Null and empty texts have no
words and are scored like any other; texts may be of any length; equal texts have
equal scores.  Rows of one id are texts of their own with that id's label (1 if
any says so); null ids have no label.  Without confirmed examples every score is
the class prior, 0 without toxic labels; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import GOLDEN, LOWER, flat, mix, padded, span_hashes, text_chunks, word_spans

#: Confirmed examples that teach, at most.
POSITIVES = 20_000
#: Class prior where no text is labelled 0.
PRIOR = 0.05
HASHES, BUCKETS = 3, 1 << 17
#: Standard deviations by which counts are moved to their cautious ends.
CAUTION = 1.5
#: Evidence from which a word counts as strong.
STRONG = 1.0
#: Greatest value and number of levels of each statistic.
STATS = (("first", 4.0, 24), ("second", 4.0, 12), ("third", 4.0, 8), ("sum", 4.0, 10), ("strong", 3.0, 6), ("share", 0.5, 4))
LEVELS = tuple(n for _, _, n in STATS)
STEPS, RATE, DECAY = 1500, 0.05, 1e-3

_APART = np.ones(256, bool)
_APART[list(b"0123456789abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = False


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, HASHES counters) of every distinct word of each text, and the number of texts."""
    offsets, data = flat(column)
    data = LOWER[data]
    s, e, w = word_spans(offsets, data, _APART)
    h = span_hashes(padded(data), s, e - s)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w))
    key = mix(h + doc.astype(np.uint64) * GOLDEN)
    at = np.unique(key, return_index=True)[1]
    doc, h = doc[at], h[at]
    rows = np.arange(HASHES)
    counters = (mix(h[:, None] + (rows + 1).astype(np.uint64) * GOLDEN) >> np.uint64(40)).astype(np.int64) % BUCKETS + rows * BUCKETS
    return doc, counters, len(offsets) - 1


def evidence(toxic: np.ndarray, total: np.ndarray, n_toxic: np.ndarray, n_total: np.ndarray) -> np.ndarray:
    """Log ratio of the shares of confirmed and of all texts, 0 where caution leaves none."""
    low = np.maximum(toxic - CAUTION * np.sqrt(np.maximum(toxic, 0)), 0)
    high = total + CAUTION * np.sqrt(np.maximum(total, 0))
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(low * np.maximum(n_total, 1)) - np.log(np.maximum(high, 1e-9) * np.maximum(n_toxic, 1)), 0)


def middle(x: np.ndarray) -> np.ndarray:
    """The median of each row of three."""
    a, b, c = x.T
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


@dataclass
class Lexicon:
    """Counts of documents by counter: of confirmed examples and of all training texts."""

    toxic: np.ndarray
    total: np.ndarray
    n_toxic: int
    n_total: int

    def __post_init__(self) -> None:
        self.known = evidence(self.toxic, self.total, self.n_toxic, self.n_total)
        self.without = evidence(self.toxic - 1, self.total - 1, self.n_toxic - 1, self.n_total - 1)

    def cells(self, column: pa.Array, leave_out: np.ndarray | None = None) -> np.ndarray:
        """The histogram cell of every text; ``leave_out`` marks confirmed examples, which don't count themselves."""
        doc, counters, n = places(column)
        words = np.bincount(doc, minlength=n)
        found = middle(self.known[counters])
        if leave_out is not None and leave_out.any():
            own = leave_out[doc]
            found[own] = middle(self.without[counters[own]])
        some = found > 0
        doc, found = doc[some], found[some]
        order = np.lexsort((-found, doc))
        doc, found = doc[order], found[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = np.zeros((n, 3))
        lead = rank < 3
        top[doc[lead], rank[lead]] = found[lead]
        total = np.bincount(doc, found, minlength=n)
        strong = np.bincount(doc, found >= STRONG, minlength=n)
        x = np.column_stack([top, np.log1p(total), np.log1p(strong), np.sqrt(strong / np.maximum(words, 1))])
        level = [np.minimum(np.ceil(x[:, j] / most * (k - 1)), k - 1).astype(np.int64) for j, (_, most, k) in enumerate(STATS)]
        return np.ravel_multi_index(level, LEVELS)


def values(cells: np.ndarray) -> np.ndarray:
    """The statistics that stand for cells, each between 0 and 1."""
    return np.column_stack([v / (k - 1) for v, k in zip(np.unravel_index(cells, LEVELS), LEVELS, strict=True)])


@dataclass
class Model:
    lexicon: Lexicon
    prior: float
    weights: np.ndarray | None = None

    def score(self, cells: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(cells), self.prior)
        return 1 / (1 + np.exp(-np.clip(values(cells) @ self.weights[:-1] + self.weights[-1], -500, 500)))


def risk(weights: np.ndarray, xp: np.ndarray, wp: np.ndarray, xu: np.ndarray, wu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(positive part, corrected negative part, gradient of each) of the logistic risk; rows have a last column of ones, weights of rows sum to 1."""
    fp, fu = xp @ weights, xu @ weights
    up, uu = 1 / (1 + np.exp(-np.clip(fp, -500, 500))), 1 / (1 + np.exp(-np.clip(fu, -500, 500)))
    positive = prior * (wp @ np.logaddexp(0, -fp))
    negative = wu @ np.logaddexp(0, fu) - prior * (wp @ np.logaddexp(0, fp))
    return positive, negative, prior * ((wp * (up - 1)) @ xp), (wu * uu) @ xu - prior * ((wp * up) @ xp)


def train(positive: dict[int, int], unlabelled: dict[int, int], prior: float) -> np.ndarray:
    """Weights (the last is the constant) from histograms of both kinds of texts, by gradient steps with momentum and scaling."""

    def rows(h: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        cells = np.array(sorted(h), np.int64)
        w = np.array([h[c] for c in cells.tolist()], float)
        return np.column_stack([values(cells), np.ones(len(cells))]), w / w.sum()

    (xp, wp), (xu, wu) = rows(positive), rows(unlabelled)
    weights = np.zeros(xp.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, STEPS + 1):
        _, negative, up, down = risk(weights, xp, wp, xu, wu, prior)
        slope = (up + down if negative >= 0 else -down) + DECAY * np.append(weights[:-1], 0)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= RATE / (1 + 3 * k / STEPS) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return weights


def count(texts: DataFrame) -> Lexicon:
    """Counts over all rows of (text, confirmed); every task sends a fixed number of counters at most."""
    size = HASHES * BUCKETS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, size + 1), np.int64)  # the last counts texts
        for batch in text_chunks(batches):
            doc, counters, n = places(batch.column("text"))
            toxic = np.array(batch.column("confirmed").to_pylist(), bool)
            # Two words of one text in one counter count once.
            mark = np.unique((doc[:, None] * size + counters).ravel())
            of, at = mark // size, mark % size
            found[0, :-1] += np.bincount(at, minlength=size)
            found[1, :-1] += np.bincount(at[toxic[of]], minlength=size)
            found[:, -1] += [n, int(toxic.sum())]
        used = np.flatnonzero(found[0])
        for lo in range(0, len(used), 65536):
            k = used[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(found[0, k]), pa.array(found[1, k])], names=["k", "total", "toxic"])

    rows = texts.mapInArrow(sums, "k int, total long, toxic long").groupBy("k").agg(F.sum("total").alias("total"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, size + 1), np.int64)
    k = rows.column("k").to_numpy()
    out[0, k], out[1, k] = rows.column("total").to_numpy(), rows.column("toxic").to_numpy()
    return Lexicon(out[1, :-1], out[0, :-1], int(out[1, -1]), int(out[0, -1]))


def histogram(texts: DataFrame, lexicon: Lexicon) -> tuple[dict[int, int], dict[int, int]]:
    """(confirmed, all) rows of (text, confirmed) by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            toxic = np.array(batch.column("confirmed").to_pylist(), bool)
            cells = lexicon.cells(batch.column("text"), toxic)
            at, back = np.unique(cells, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(back)), pa.array(np.bincount(back, toxic).astype(np.int64))], names=["cell", "n", "toxic"])

    found = texts.mapInArrow(run, "cell long, n long, toxic long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow().to_pylist()
    return {r["cell"]: r["toxic"] for r in found if r["toxic"]}, {r["cell"]: r["n"] for r in found}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, most: int = POSITIVES) -> Model:
    """From training texts and training labels; ids of confirmed examples, ``most`` at most, are broadcast."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("toxic"))
    zeros, ones = known.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if prior is None:
        prior = ones / (zeros + ones) if zeros else PRIOR
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("key"), "key").limit(most).select("key", F.lit(True).alias("chosen"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key", "left").select("text", F.coalesce("chosen", F.lit(False)).alias("confirmed"))
    lexicon = count(texts)
    if not lexicon.n_toxic:
        return Model(lexicon, float(prior if ones else 0))
    positive, unlabelled = histogram(texts, lexicon)
    prior = min(max(prior, 1e-6), 0.99)
    return Model(lexicon, prior, train(positive, unlabelled, prior))


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each text."""
    src = df.select(F.struct(*keep).alias("rest"), F.col(text).alias("text"))
    schema = src.select("rest", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = model.score(model.lexicon.cells(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(found)], names=["rest", "score"])

    scored = src.mapInArrow(run, schema)
    return scored.select(*(F.col("rest").getField(c).alias(c) for c in keep), F.col("score").alias(out))
