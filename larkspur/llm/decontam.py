"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item (an item with fewer words,
but not none, is one window).  Of the k-grams in each window (k about half its
length) the one with the smallest hash, leftmost on ties, is its fingerprint.
Equal windows have equal fingerprints at equal places, so every shared window
is found: a document keeps the fingerprints of its own windows, the ones that
no item has fall out, and each remaining hit is extended to its whole window
and compared word by word (as 64-bit hashes of all its words) with the items'.

Item windows are held by every task only where ``limit`` bounds their number
(one window takes about 150 bytes); beyond it the fingerprints, then the
extended windows, are matched by shuffle joins with the same results.

Null and wordless texts have no words and no hits; null and wordless items no
windows.  Repeated items count once each under their own id; repeated document
rows each get their result.  Texts may be of any length.  Of fingerprints that tie
the leftmost counts.  Columns of any name pass through (those of the results are
replaced); an empty table gives an empty result, no items no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.kernels import GOLDEN, LOWER, U64, flat, gram_hashes, mix, padded, removal_mask, span_hashes, text_chunks, window_argmin, word_spans
from larkspur.llm.tables import free, written

WINDOW = 10
#: Item windows up to which they are sent to every task (about 150 bytes each).
BROADCAST_WINDOWS = 200_000

#: Words are runs of digits, a-z (after lower-casing A-Z) and bytes of other characters than ASCII.
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[97:123] = BREAK[128:] = False


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets per text)."""
    offsets, data = flat(column)
    low = LOWER[data]
    s, e, w = word_spans(offsets, low, BREAK)
    return span_hashes(padded(low), s, e - s), w


def fold(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * GOLDEN + rows[:, k])
    return h


def fingerprints(h: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of the window at every position: the smallest of its k-gram hashes."""
    k = (length + 1) // 2
    grams = gram_hashes(h, k)
    return grams[window_argmin(grams, length - k + 1)] + U64(length)


def inside(words: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a window of this length lies within one text."""
    n = int(words[-1])
    if n < length:
        return np.zeros(n, bool)
    ok = np.zeros(n, bool)
    ok[: n - length + 1] = True
    doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
    ok[: n - length + 1] &= doc[: n - length + 1] == doc[length - 1 :]
    return ok


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """Distinct windows of each item: item, length, fingerprint, hash, and its word hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            h, w = word_hashes(batch.column("text"))
            for length in range(1, window + 1):
                ok = inside(w, length)
                if length < window:
                    whole = np.flatnonzero(np.diff(w) == length)
                    own = np.zeros(len(ok), bool)
                    own[w[whole]] = True
                    ok &= own
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                rows = h[at[:, None] + np.arange(length)]
                item = batch.column("item").take(pa.array(np.searchsorted(w, at, "right") - 1))
                yield pa.RecordBatch.from_arrays(
                    [item, pa.array(np.full(len(at), length, np.int32)), pa.array(fingerprints(h, length)[at].view(np.int64)), pa.array(fold(rows).view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["item", "length", "print", "win", "words"],
                )

    src = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    return src.mapInArrow(read, "item string, length int, print long, win long, words binary").distinct()


class Held:
    """Item windows as arrays, for tasks."""

    def __init__(self, rows: list):
        self.of: dict[int, tuple] = {}
        by: dict[int, dict[bytes, list]] = {}
        for r in rows:
            by.setdefault(r["length"], {}).setdefault(bytes(r["words"]), [r["print"], r["win"], []])[2].append(r["item"])
        for length, found in by.items():
            win = np.array([v[1] for v in found.values()], np.int64).view(np.uint64)
            order = np.argsort(win, kind="stable")
            words = np.frombuffer(b"".join(found), np.uint64).reshape(len(found), length)[order]
            items = list(found.values())
            self.of[length] = (np.unique(np.array([v[0] for v in items], np.int64).view(np.uint64)), win[order], words, [items[k][2] for k in order])

    def hits(self, h: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, window starts in the texts, number of the item window)."""
        for length, (prints, win, words, _) in self.of.items():
            ok = inside(w, length)
            n = len(h) - length + 1
            if n <= 0 or not ok.any():
                continue
            own = fingerprints(h, length)
            at = np.searchsorted(prints, own)
            at[at == len(prints)] = 0
            starts = np.flatnonzero(ok[:n] & (prints[at] == own))
            rows = h[starts[:, None] + np.arange(length)]
            lo = np.searchsorted(win, key := fold(rows))
            while len(starts):
                fits = lo < len(win)
                fits[fits] = win[lo[fits]] == key[fits]
                starts, rows, lo, key = starts[fits], rows[fits], lo[fits], key[fits]
                same = (words[lo] == rows).all(axis=1)
                yield length, starts[same], lo[same]
                starts, rows, lo, key = starts[~same], rows[~same], lo[~same] + 1, key[~same]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def judge(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """Adds RESULT to every document row; columns of those names are replaced."""
    docs = docs.drop(*_NAMES)
    windows = item_windows(items, item_key, item_text)
    rows = windows.limit(limit + 1).collect()
    return _by_broadcast(docs, rows, text) if len(rows) <= limit else _by_joins(docs, written(windows, "windows"), text)


def _by_broadcast(docs: DataFrame, rows: list, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Held(rows))
    schema = docs.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in RESULT.split(", "))).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in text_chunks(batches, text):
            h, w = word_hashes(batch.column(text))
            found: dict[int, set] = {}
            starts, lengths = [], []
            for length, at, number in held.hits(h, w):
                starts.append(at)
                lengths.append(np.full(len(at), length))
                own = held.of[length][3]
                for d, k in set(zip((np.searchsorted(w, at, "right") - 1).tolist(), number.tolist(), strict=True)):
                    found.setdefault(d, set()).update(own[k])
            mask = removal_mask(len(h), np.concatenate(starts), np.concatenate(lengths)) if starts else np.zeros(len(h), bool)
            total = np.concatenate([[0], np.cumsum(mask)])
            hit = total[w[1:]] - total[w[:-1]]
            own_items = [found.get(d, ()) for d in range(batch.num_rows)]
            out = [pa.array(np.diff(w).astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array([len(x) for x in own_items], pa.int64()), pa.array([digest(list(x)) for x in own_items], pa.string()), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *_NAMES])

    return docs.mapInArrow(read, schema)


def _by_joins(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The same by shuffle joins: first of fingerprints, then of the windows that they extend to."""
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW values at most
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct()  # equal texts are judged once

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "_t"):
            h, w = word_hashes(batch.column("_t"))
            keys = [hashlib.sha256(t.encode()).digest() for t in batch.column("_t").to_pylist()]
            doc = np.repeat(np.arange(len(w) - 1), np.diff(w))
            for length in lengths:
                at = np.flatnonzero(inside(w, length))
                if not len(at):
                    continue
                own = fingerprints(h, length)[at]
                new = np.ones(len(at), bool)  # windows in a row with one fingerprint travel together
                new[1:] = (own[1:] != own[:-1]) | (doc[at][1:] != doc[at][:-1])
                first = np.flatnonzero(new)
                size = np.diff([*first, len(at)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[d] for d in doc[at[first]]], pa.binary()), pa.array(np.full(len(first), length, np.int32)), pa.array(own[first].view(np.int64)), pa.array(at[first] - w[doc[at[first]]]), pa.array([h[a : a + n + length - 1].tobytes() for a, n in zip(at[first], size, strict=True)], pa.binary())],
                    names=["key", "length", "print", "start", "run"],
                )

    runs = texts.mapInArrow(extended, "key binary, length int, print long, start long, run binary").join(windows.select("length", "print").distinct(), ["length", "print"], "left_semi")
    spread = runs.withColumn("i", F.explode(F.sequence(F.lit(0), (F.octet_length("run") / 8).cast("int") - F.col("length"))))
    starts = spread.select("key", "length", (F.col("start") + F.col("i")).alias("start"), F.expr("substring(run, i * 8 + 1, length * 8)").alias("words"))
    hits = written(starts.join(windows.select("words", "length").distinct(), ["words", "length"], "left_semi"), "hits")
    named = hits.select("key", "words", "length").distinct().join(windows.select("words", "length", "item"), ["words", "length"]).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("item")), ",").alias("joined"), F.countDistinct("item").alias("n_items"))
    # Each hit adds the words beyond the furthest end before it: one sort of a text's hits, no list of places.
    end, before = F.col("start") + F.col("length"), Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    fresh = hits.withColumn("new", F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0)))
    spots = fresh.groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    found = spots.join(named, "key")
    nothing = F.coalesce
    key, more = free("_key", docs.columns), free("_found", docs.columns)
    found = found.select(F.col("key").alias(key), F.struct("n_hit", "n_items", "joined").alias(more))
    counted = docs.withColumn(key, F.unhex(F.sha2(nothing(F.col(text), F.lit("")).cast("binary"), 256)))
    lowered = F.translate(nothing(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.size(F.filter(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda x: x != "")).cast("long")
    joined, of = counted.join(found, key, "left"), F.col(more)
    return joined.select(*docs.columns, n_words.alias("n_words"), nothing(of["n_hit"], F.lit(0)).alias("n_hit"), nothing(of["n_items"], F.lit(0)).alias("n_items"), F.sha2(nothing(of["joined"], F.lit("")), 256).alias("items_sha256"), of.isNotNull().alias("contaminated"))


#: DuckDB SQL of the whole query over ``documents`` and ``benchmark``.
SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (SELECT d.doc_id, d.n, d.i, win.item_id FROM dwin d JOIN win ON d.n = win.n AND d.s = win.s),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""
