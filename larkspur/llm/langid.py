"""Language ID by string kernels: blended-spectrum presence kernel, Nyström landmarks, kernel ridge regression.

A text is the set of its letter n-grams, n = 1..``ORDER`` (lower case; a run of
other characters is one boundary symbol), hashed to ``BUCKETS`` presence flags.
The kernel of two texts is the cosine of their flags.  ``fit`` takes a bounded
sample (``per_class`` rows of each language, the ones with the smallest hash of
their text), of which ``landmarks`` in all are the Nyström landmarks, and
solves one ridge problem per language against the rest.

A batch of texts is scored by one matrix product.  With presence flags P,
landmark flags L and dual coefficients A the outputs are P Lᵀ A / |P|; Lᵀ A
doesn't depend on the batch and is multiplied out once.

The outputs of all languages sum to 1 for every text, so they can't tell that a
text is in none of them.  Its share of n-grams that the sample of the predicted
language has too can: ``fit`` sets the least share of each language from the
labelled sample, half way between what its own texts share with one another
(all but the lowest ``ODD``) and what the texts of other languages share with
them.  ``predict`` can add whether a text reaches it.

Null, empty and letterless texts are ``und`` with score 0.  Ties go to the
language that sorts first.  Texts may be of any length: flags are of fixed size.
Repeated texts teach once; every row is scored.  Columns of any name pass through
(those of the results are replaced); an empty table gives an empty result, and
without labels every text is ``und``.  A model takes 256 kB a language in every task:
more than ``LANGUAGES`` of them are refused with an error before anything is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.kernels import text_chunks

ORDER, BUCKETS = 3, 1 << 15
PER_CLASS, LANDMARKS, RIDGE = 600, 256, 1e-3
#: Languages of one model, at most: it is held by the driver and by every task.
LANGUAGES = 500
#: Share of labelled texts that may be odd ones (mislabelled, junk) when the least share is set.
ODD = 0.01
UNKNOWN = "und"
ROWS = 64  #: texts in one matrix product


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def presence(texts: list[str]) -> np.ndarray:
    """uint8 flags, one row of BUCKETS for each text; letterless texts have none."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low], np.int64)  # a boundary before and after
    codes = np.frombuffer("".join(f"\n{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
    letter = letters()[codes]
    some = np.zeros(len(low), bool)
    some[row[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    start = np.cumsum(sizes) - sizes
    keep[start] = True
    keep &= some[row]
    c = np.where(letter, codes, 0).astype(np.uint32)[keep]
    row = row[keep]
    flags = out.ravel()
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, ORDER + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x85EBCA6B) + (c[n - 1 :] + np.uint32(n)) * np.uint32(0xC2B2AE35)
        x = h ^ (h >> np.uint32(15))
        at = row[: len(h)] * BUCKETS + ((x * np.uint32(0x9E3779B1)) >> shift)
        flags[at if n == 1 else at[row[: len(h)] == row[n - 1 :]]] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  #: BUCKETS x languages: landmark flags times dual coefficients
    bias: np.ndarray
    known: np.ndarray  #: BUCKETS x languages: whether the sample of the language has the flag
    least: np.ndarray  #: least share of known flags of a text in the language

    def outputs(self, flags: np.ndarray) -> np.ndarray:
        """Ridge outputs, about 1 for the language and 0 for the rest."""
        p = flags.astype(np.float32)
        norm = np.sqrt(p.sum(axis=1, keepdims=True))
        return p @ self.weights / np.maximum(norm, 1) + self.bias

    def shares(self, flags: np.ndarray) -> np.ndarray:
        """The share of each text's flags that each language knows."""
        return shares(flags, self.known)


def shares(flags: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The share of each row's flags that each column of ``known`` has, some rows at a time."""
    parts = [flags[lo : lo + ROWS] for lo in range(0, len(flags), ROWS)]
    counts = [(p.astype(np.float32) @ known) / np.maximum(p.sum(axis=1, keepdims=True, dtype=np.int64), 1) for p in parts]
    return np.concatenate(counts) if counts else np.zeros((0, known.shape[1]))


def least_shares(flags: np.ndarray, own: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The least share of each language, from labelled texts; ``own`` are their languages' numbers, ``df`` the number of texts of each language with a flag."""
    n = df.shape[1]
    found = shares(flags, np.concatenate([df > 0, df > 1], axis=1).astype(np.float32))  # a flag that another text has too occurs twice
    out = np.zeros(n)
    for c in range(n):
        low = np.quantile(found[own == c, n + c], ODD)
        others = found[own != c, c]
        out[c] = min(low, (low + (np.median(others) if len(others) else 0)) / 2)
    return out


def solve(flags: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of the sample, then ridge regression on them."""
    languages = sorted(set(labels))
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))

    def unit(part: np.ndarray) -> np.ndarray:
        x = part.astype(np.float32)
        return x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)

    y = np.array([[lab == c for c in languages] for lab in labels], np.float64)
    turn: dict[str, int] = {}
    rank = []
    for lab in labels:  # landmarks are spread evenly over the languages
        turn[lab] = turn.get(lab, 0) + 1
        rank.append(turn[lab])
    marks = unit(flags[np.argsort(rank, kind="stable")[:landmarks]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    z = np.concatenate([unit(flags[lo : lo + ROWS]) @ marks.T for lo in range(0, len(flags), ROWS)]) @ root  # the sample as floats would be four times as large
    mean, target = z.mean(axis=0), y.mean(axis=0)
    z0 = z - mean
    beta = np.linalg.solve(z0.T @ z0 + ridge * len(z) * np.eye(z.shape[1]), z0.T @ (y - target))
    dual = root @ beta
    own = y.argmax(axis=1)
    df = np.stack([flags[own == c].sum(axis=0, dtype=np.int32) for c in range(len(languages))], axis=1)
    return Model(languages, (marks.T.astype(np.float64) @ dual).astype(np.float32), (target - mean @ beta).astype(np.float32), (df > 0).astype(np.float32), least_shares(flags, own, df))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", per_class: int = PER_CLASS, landmarks: int = LANDMARKS) -> Model:
    """Learns from rows with a text and a language; at most ``per_class`` distinct texts of each language are used.

    Counts come first, so that only about the rows that the sample needs are
    shuffled, and only flags of fixed size (4 kB a row) reach the driver.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64("text").bitwiseAND((1 << 62) - 1))
    counts = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().limit(LANGUAGES + 1).collect()}  # copies don't count
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return solve(np.zeros((0, BUCKETS), np.uint8), [])
    below = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, 6 * per_class / n) * (1 << 62)))))
    near = rows.where(F.col("h") <= below[F.col("lang")]).dropDuplicates(["lang", "h"])
    picked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_class)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                bits = np.packbits(presence(part.column("text").to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "h", "bits"])

    sample = sorted(picked.select("lang", "h", "text").mapInArrow(pack, "lang string, h long, bits binary").collect(), key=lambda r: (r["lang"], r["h"]))
    flags = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), np.uint8).reshape(len(sample), -1), axis=1)
    return solve(flags, [r["lang"] for r in sample], landmarks)


def predict(df: DataFrame, model: Model, text: str = "text", out: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language, its output clipped to 0..1 and, if ``out`` has a third name, whether the
    text is in that language at all (see ``Model.least``); columns of these names are replaced."""
    df = df.drop(*out)
    schema = df.select("*", *(F.lit(v).alias(k) for k, v in zip(out, ("", 0.0, True), strict=False))).schema
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x LANGUAGES at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_chunks(batches, text):
            names, scores, inside = [], [], []
            raw = [t or "" for t in batch.column(text).to_pylist()]
            for lo in range(0, len(raw), ROWS):
                flags = presence(raw[lo : lo + ROWS])
                best = (f := m.outputs(flags)).argmax(axis=1)
                known = flags.any(axis=1)
                names += [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores.append(np.where(known, np.clip(f[np.arange(len(f)), best], 0, 1), 0).astype(np.float64))
                if len(out) > 2:
                    inside.append(known & (m.shares(flags)[np.arange(len(f)), best] >= m.least[best]))
            found = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), *([pa.array(np.concatenate(inside))] if inside else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *out])

    return df.mapInArrow(score, schema)
