"""Substring dedup of word sequences with compressed FM-indexes.

A word goes if a window of ``WINDOW`` words that covers it also starts earlier:
in a document with a smaller id, or further up in the same one.  ``segments``
drops the windows that can't repeat and routes the rest by anchor, so that all
occurrences of a window meet in one shard.  Each shard builds an FM-index of
its stretches (Burrows-Wheeler transform in a wavelet matrix with packed bits and
block counts, a sample of the suffix array) and streams the same stretches
through it: backward search, for all positions at once, gives the matching
statistics up to the threshold; of the intervals that reach it the occurrences
are located by walking back to a sampled place, and the first is reported.  A
position is out of the search as soon as its interval holds it alone.

An anchor with more than ``HOT`` different stretches isn't put in one shard:
its stretches are cut into single windows, which Spark collapses like any equal
stretches, and each then is its own group.

Null texts have no words; words are runs of other bytes than white space and
stay unchanged.  Rows with the same id count as one document whose windows are
ordered by start alone, each with its own result; rows without an id come last.
Texts may be of any length.  Of equal windows the one of the smallest (id, start)
stays.  Only id and text are read, so other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import SPACE, U64, flat, padded, ranges, removal_mask, text_chunks, word_spans
from larkspur.llm.segments import Spec, ambiguous, firsts, removed_runs, repeated_anchors, runs_of, stored
from larkspur.llm.tables import drop, written

WINDOW, GRAM, HOT = 20, 8, 5_000
SPEC = Spec(WINDOW, GRAM, words=True)
#: One position of so many is kept in an index.
SAMPLE = 8
#: Bytes of stretches that one index holds.
SHARD_BYTES = 4 << 20


class Bits:
    """A packed bit vector with the number of ones before each word of it."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.zeros((len(bits) >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        self.packed.view(np.uint8)[: len(raw)] = raw
        self.counts = np.zeros(len(self.packed), np.int32)
        np.cumsum(np.bitwise_count(self.packed[:-1]), out=self.counts[1:], dtype=np.int32)

    def before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.packed[word] & ((U64(1) << (at & 63).astype(np.uint64)) - U64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1) == 1


class WaveletMatrix:
    """Rank over a sequence of integers: one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        n, x = len(symbols), symbols.astype(np.int64)
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            ones = (x >> bit) & 1 == 1
            self.levels.append((bit, Bits(ones), n - int(ones.sum())))
            x = np.concatenate([x[~ones], x[ones]])
        self.base = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.before(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """What stands at each place."""
        out = np.zeros(len(at), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.before(at)
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by the order of their suffixes, by doubling.

    Every 0 is a symbol of its own, smaller than those that follow, so suffixes
    differ by the end of their stretch at the latest.
    """
    end = text == 0
    n, rank, h = len(text), np.where(end, np.cumsum(end) - 1, text + int(end.sum())).astype(np.uint64), 1
    while True:
        ahead = np.concatenate([rank[h:], rank[:h]]) if h < n else rank
        key = (rank << U64(32)) | ahead
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.ones(n, np.uint64)
        new[0] = 0
        new[1:] = k[1:] != k[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        h *= 2
        if h >= n or int(rank.max()) == n - 1:
            return order


class FMIndex:
    """Index of a text of integers; 0 ends each stretch and is never searched for.

    Kept are the wavelet matrix of the Burrows-Wheeler transform, the place of
    every ``SAMPLE``-th position of the text and of the first of each stretch, and a
    bit for each row that says whether its place is kept; other places are found
    by walking back, which so never leaves a stretch.
    """

    def __init__(self, text: np.ndarray, alphabet: int):
        order = suffix_order(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept = Bits(kept)
        self.places = order[kept].astype(np.int32)

    def statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the positions ``ends`` of a text of the index, all at once.

        For each the length, up to ``most``, of the longest string that ends
        there and occurs a second time, and the interval of its occurrences.
        The text is read backwards from each; 0 and the begin of the text stop it.
        """
        c = text[ends]
        lo, hi = self.first[c], self.first[c + 1]
        length = np.where(hi - lo > 1, 1, 0)
        live = np.flatnonzero(length)
        for k in range(1, most):
            c = text[ends[live] - k]
            ok = c > 0
            live, c = live[ok], c[ok]
            if not len(live):
                break
            a, b = self.first[c] + self.matrix.rank(c, lo[live]), self.first[c] + self.matrix.rank(c, hi[live])
            ok = b - a > 1
            live = live[ok]
            lo[live], hi[live], length[live] = a[ok], b[ok], k + 1
        return length, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes in these rows."""
        at, steps, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            left = left[~self.kept.get(at[left])]
            c = self.matrix.symbol(at[left])
            at[left] = self.first[c] + self.matrix.rank(c, at[left])
            steps[left] += 1
        return self.places[self.kept.before(at)] + steps


def earlier(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window offset) of windows that start earlier in another stretch.

    ``words`` are word ids from 0 of all stretches, ``sizes`` and ``counts``
    their words and windows, (doc, start) the place of their first word.
    """
    seg = np.repeat(np.arange(len(sizes)), sizes)
    text = np.zeros(len(words) + len(sizes), np.int64)
    at = np.arange(len(words)) + seg
    text[at] = words + 1
    alphabet = int(text.max()) + 1 if len(text) else 1
    if not len(words):
        return seg, seg
    index = FMIndex(text, alphabet)
    begin = np.cumsum(sizes) - sizes + np.arange(len(sizes))
    of = np.repeat(np.arange(len(counts)), counts)
    starts = ranges(begin, counts)
    gone_seg, gone_off = [], []
    for lo_ in range(0, len(starts), 1 << 18):  # streamed
        part, own = starts[lo_ : lo_ + (1 << 18)], of[lo_ : lo_ + (1 << 18)]
        length, lo, hi = index.statistics(text, part + window - 1, window)
        live = np.flatnonzero(length >= window)
        if not len(live):
            continue
        lo, hi = lo[live], hi[live]
        uniq, back = np.unique(lo, return_inverse=True)
        top = np.zeros(len(uniq), np.int64)
        top[back] = hi
        spots = index.locate(ranges(uniq, top - uniq))
        s = np.searchsorted(begin, spots, "right") - 1
        place = start[s] + spots - begin[s]
        group = np.repeat(np.arange(len(uniq)), top - uniq)
        best = np.lexsort((place, doc[s], group))
        head = best[np.flatnonzero(np.append(True, group[best][1:] != group[best][:-1]))]
        d, p = doc[s[head]][back], place[head][back]
        mine_d, mine_p = doc[own[live]], start[own[live]] + part[live] - begin[own[live]]
        gone = (d < mine_d) | ((d == mine_d) & (p < mine_p))
        gone_seg.append(own[live][gone])
        gone_off.append((part[live] - begin[own[live]])[gone])
    return (np.concatenate(gone_seg), np.concatenate(gone_off)) if gone_seg else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word among the distinct ones, words per stretch): equal numbers mean equal bytes."""
    offsets, data = flat(column)
    s, e, w = word_spans(offsets, data, SPACE)
    ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(data[ranges(s, e - s)])])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64), np.diff(w)


def _solve(table: pa.Table) -> list[pa.RecordBatch]:
    if not table.num_rows:
        return []
    words, sizes = word_ids(table.column("content"))
    seg, off = earlier(words, sizes, np.asarray(table.column("n")).astype(np.int64), np.asarray(table.column("doc")), np.asarray(table.column("start")).astype(np.int64))
    order = np.lexsort((off, seg))
    seg, off = seg[order], off[order]
    head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
    rows = table.take(pa.array(seg[head]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(seg)), pa.int32()), pa.array(off.astype(np.int32)))
    return pa.table([rows.column("anchor"), rows.column("key"), lists], names=["anchor", "key", "gone"]).to_batches()


def by_index(segs: DataFrame) -> DataFrame:
    """(anchor, key, gone): one FM-index per shard of whole anchors."""
    total = segs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(6, -(-int(total) // SHARD_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by anchor: an anchor's stretches come in a row
            held.append(batch)
            size += batch.nbytes
            if size >= 2 * SHARD_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                anchors = np.asarray(table.column("anchor"))
                whole = int(np.searchsorted(anchors, anchors[-1], "left"))
                if whole:
                    yield from _solve(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from _solve(pa.Table.from_batches(held).combine_chunks())

    dealt = segs.select("anchor", "key", "doc", "start", "n", "content").repartition(shards, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, "anchor long, key long, gone array<int>")


def by_windows(segs: DataFrame) -> DataFrame:
    """(anchor, key, gone) for anchors with many stretches: single windows, collapsed by Spark."""
    words = F.split(F.decode("content", "ISO-8859-1"), " ")
    spread = segs.select("anchor", "key", "doc", "start", "n", words.alias("w")).select("anchor", "key", "doc", "start", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("off"))
    window = F.sha2(F.array_join(F.slice("w", F.col("off") + 1, WINDOW), " ").cast("binary"), 256)
    place = F.struct("doc", (F.col("start") + F.col("off")).alias("start"))
    rows = spread.select("anchor", "key", "off", window.alias("window"), place.alias("place"))
    least = rows.groupBy("window").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("window", "least")
    return rows.join(least, "window").where("least < place").groupBy("anchor", "key").agg(F.array_sort(F.collect_list("off")).alias("gone"))


def duplicates(docs: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """(row, starts, counts, own, gone): see ``removed_runs``."""
    hits = repeated_anchors(docs, SPEC, n)
    first = firsts(docs, hits, SPEC, n)
    found, few, many = ambiguous(docs, first, SPEC, hot)
    masks = by_index(few)
    if many.limit(1).count():
        masks = masks.unionByName(by_windows(many))
    masks = written(masks, "masks")
    drop(found)
    runs = written(removed_runs(docs, hits, first, masks, SPEC, by_start=True), "runs")
    drop(hits, first, masks)
    return runs


def kept_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, removed words, the others joined by one space) of each text."""
    offsets, data = flat(batch.column("text"))
    s, e, w = word_spans(offsets, data, SPACE)
    gone = removal_mask(len(s), *runs_of(batch, w, SPEC))
    before = np.concatenate([[0], np.cumsum(gone)])
    size = (e - s)[~gone] + 1
    out = padded(data)[ranges(s[~gone], size)]
    ends = np.concatenate([[0], np.cumsum(size)])
    out[ends[1:] - 1] = 32
    left, at = out.tobytes(), ends[w - before[w]].tolist()
    return np.diff(w), np.diff(before[w]), [left[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


def dedup(corpus: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: id, words, removed words, digest and (``with_text``) the kept words joined by one space."""
    docs, n = stored(corpus, "fm", key, text)
    joined = docs.select("row", "id", "text").join(duplicates(docs, n, hot), "row", "left").drop("row")
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            words, gone, kept = kept_words(batch)
            cols = [batch.column("id"), pa.array(words.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode() for x in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, schema)


#: DuckDB SQL of the whole query over ``documents``.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM dw WHERE len(w) >= 20)
), ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""
