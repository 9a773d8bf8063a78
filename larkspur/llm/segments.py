"""Finding repeated windows: content-routed segments of token sequences.

A window is W consecutive tokens (bytes or words) of one text.  Its anchor is
the smallest k-gram hash in it (leftmost on ties), so equal windows have equal
anchors at equal places.  Consecutive windows with the same anchor position
form a segment of at most W - k + 1 windows.  A window can only repeat if its
anchor's hash occurs twice in the corpus; segments with other anchors drop out
at once, the rest are grouped by anchor, where all occurrences of a window meet
whatever documents they come from.  Equal segments are collapsed to one with its
first occurrence before any of them is searched; groups of copies so cost what
one copy costs.

Everything here is exact but for 48-bit anchors being a superset filter and for
equality of whole segments, which is by a 112-bit key (anchor and content hash).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.kernels import GOLDEN, SPACE, U64, flat, gram_hashes, mix, padded, ranges, span_hashes, text_chunks, window_argmin, word_spans, words64
from larkspur.llm.tables import bucketed, buckets_for, drop, written

#: Text bytes per bucket of the stored corpus and of the anchor exchange.
BUCKET_BYTES = 24 << 20
PIECE = 1 << 20
#: Anchors are sent as six bytes: a few more chance meetings, a quarter less to move.
ANCHOR = U64((1 << 48) - 1)


def packed(anchors: np.ndarray) -> bytes:
    return anchors.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


@dataclass(frozen=True)
class Spec:
    """What is searched: windows of W tokens with anchors of k tokens."""

    window: int
    gram: int
    words: bool  #: tokens are words; else bytes

    def bounds(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(token offsets per text, bytes, word starts, word ends)."""
        offsets, data = flat(column)
        if not self.words:
            return offsets, padded(data), None, None
        s, e, w = word_spans(offsets, data, SPACE)
        return w, padded(data), s, e

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(k-gram hashes, token offsets per text, bytes, word starts, word ends)."""
        offsets, data = flat(column)
        buf = padded(data)
        if self.words:
            s, e, w = word_spans(offsets, data, SPACE)
            return gram_hashes(span_hashes(buf, s, e - s), self.gram), w, buf, s, e
        at = words64(buf)
        n = max(0, len(data) - self.gram + 1)
        h = at[:n] * GOLDEN
        for k in sorted({*range(8, self.gram - 7, 8), self.gram - 8} - {0}):
            h ^= h >> U64(32)
            h += at[k : k + n]
            h *= GOLDEN
        return mix(h), offsets, buf, None, None


def cut(grams: np.ndarray, offsets: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of windows, anchor hash) of every segment of a chunk."""
    sel = window_argmin(grams, spec.window - spec.gram + 1)
    counts = np.maximum(np.diff(offsets) - spec.window + 1, 0)
    at = ranges(offsets[:-1], counts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = sel[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), grams[own[first]]


def stored(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text", rest: bool = False) -> tuple[DataFrame, int]:
    """(row, doc, id, text and, if asked for, whether that was null and a struct of the other columns) as a table bucketed by row in the shared folder, so that joins by row don't move texts again.

    ``row`` is a number of our own, for repeated and missing ids; rows without
    an id come after all others in the order of documents.
    """
    n = buckets_for(docs, text, BUCKET_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(F.col(text).isNull().alias("no_text"), F.struct(*(c for c in docs.columns if c != text)).alias("of")).alias("rest")] if rest else []))
    return bucketed(rows, name, n, "row"), n


def repeated_anchors(docs: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    """(row, starts, windows, anchors) of the segments whose anchor occurs more than once.

    Tasks deal the anchors of a chunk of texts to buckets as packed arrays, and get back those that are left as packed arrays again.  Of an anchor
    that a chunk already has twice only one goes there (its segments are known
    to be candidates): a very common anchor costs one entry a chunk.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for chunk, batch in enumerate(text_chunks(batches, budget=PIECE), task):
            grams, offsets, *_ = spec.tokens(batch.column("text"))
            start, count, anchor = cut(grams, offsets, spec)
            if not len(start):
                continue
            anchor = anchor & ANCHOR
            doc = np.searchsorted(offsets, start, "right") - 1
            row = np.asarray(batch.column("row"))[doc]
            start = start - offsets[doc]
            order = np.argsort(anchor, kind="stable")
            a = anchor[order]
            head = np.ones(len(a), bool)
            head[1:] = a[1:] != a[:-1]
            twice = np.append(~head[1:], False) | ~head
            bucket = ((a >> U64(8)) % U64(buckets)).astype(np.int64)
            kind = np.where(twice & head, 1, 0)  # 1: repeated for certain
            lists = [[], [], [], [], [], []]
            keep = head
            by = np.argsort(bucket[keep], kind="stable")
            idx = np.flatnonzero(keep)[by]
            edges = np.searchsorted(bucket[idx], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                i = idx[edges[b] : edges[b + 1]]
                o = order[i]
                i, o = i[r := np.argsort(o)], o[r]
                for k, v in enumerate((int(b), packed(a[i]), row[o].tobytes(), start[o].astype(np.int32).tobytes(), count[o].astype(np.uint8).tobytes(), kind[i].astype(np.uint8).tobytes())):
                    lists[k].append(v)
            o = order[twice & ~head]
            if len(o):
                own = -1 - int(anchor[0] % U64(buckets))  # known already: any task will do
                for k, v in enumerate((own, packed(anchor[o]), row[o].tobytes(), start[o].astype(np.int32).tobytes(), count[o].astype(np.uint8).tobytes(), b"\1" * len(o))):
                    lists[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(lists[0]), pa.int64()), *(pa.array(v, t) for v, t in zip(lists, (pa.int32(), *[pa.binary()] * 5), strict=True))], names=["chunk", "bucket", "anchor", "row", "start", "n", "kind"])

    sent = docs.select("row", "text").mapInArrow(send, "chunk long, bucket int, anchor binary, row binary, start binary, n binary, kind binary")

    def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
        raw = lambda k: b"".join(x.as_py() for x in table.column(k))
        return unpack(raw("anchor")), *(np.frombuffer(raw(k), t) for k, t in (("row", np.int64), ("start", np.int32), ("n", np.uint8)))

    def split(table: pa.Table) -> pa.Table:
        anchor, row, start, n = unpacked(table)
        sel = repeated(anchor, np.frombuffer(b"".join(x.as_py() for x in table.column("kind")), np.uint8))
        sizes = np.array([len(x.as_py()) for x in table.column("n")], np.int64)
        kept = np.add.reduceat(sel.astype(np.int64), np.cumsum(sizes) - sizes)  # every packed array has an entry
        parts = [np.split(v[sel], np.cumsum(kept)[:-1]) for v in (anchor, row, start, n)]
        some = np.flatnonzero(kept)
        return pa.table([table.column("chunk").combine_chunks().take(pa.array(some)), pa.array([packed(parts[0][i]) for i in some], pa.binary()), *(pa.array([p[i].tobytes() for i in some], pa.binary()) for p in parts[1:])], names=["chunk", "anchor", "row", "start", "n"])

    def gather(table: pa.Table) -> pa.Table:
        """The rows of one chunk: each has all of its segments here."""
        anchor, row, start, n = unpacked(table)
        order = np.lexsort((start, row))
        anchor, row, start, n = anchor[order], row[order], start[order], n[order]
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        ends = pa.array(np.append(head, len(row)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (start.astype(np.int32), n.astype(np.int32), anchor.view(np.int64))]
        return pa.table([pa.array(row[head]), *lists], names=["row", "starts", "counts", "anchors"])

    def repeated(anchor: np.ndarray, kind: np.ndarray) -> np.ndarray:
        order = np.argsort(anchor, kind="stable")
        a = anchor[order]
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        same[:-1] |= same[1:]
        out = np.zeros(len(a), bool)
        out[order] = same
        return out | (kind == 1)

    met = sent.groupBy("bucket").applyInArrow(split, "chunk long, anchor binary, row binary, start binary, n binary")
    met = written(met, "met")  # the first exchange's files can go before the second's come
    per = met.groupBy("chunk").applyInArrow(gather, "row long, starts array<int>, counts array<int>, anchors array<long>")
    hits = bucketed(per, "hits", buckets, "row")
    drop(met)
    return hits


def _occurrences(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, bytes, number of the text, start, n, content hash, first byte, end) of the segments that each chunk lists."""
    for batch in text_chunks(batches):
        offsets, buf, ws, we = spec.bounds(batch.column("text"))
        sizes = np.diff(np.asarray(batch.column("starts").offsets))
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        start = np.asarray(batch.column("starts").flatten()).astype(np.int64)
        n = np.asarray(batch.column("counts").flatten()).astype(np.int64)
        lo = offsets[doc] + start
        if ws is None:
            a, b = lo, lo + n + spec.window - 1
            key = span_hashes(buf, a, b - a)
        else:
            a, b = ws[lo], we[lo + n + spec.window - 2]
            key = window_keys(buf, ws, we, lo, n + spec.window - 1)
        yield batch, buf, doc, start, n, key.view(np.int64), a, b


def _pieces(docs: DataFrame, lists: DataFrame, spec: Spec, with_content: bool) -> DataFrame:
    """(anchor, key, row, doc, start, n and, if asked for, content and c) of the segments in ``lists`` (row, starts, counts, anchors and, for content, cs).

    ``key`` is a second 64-bit hash, of the content; the content is bytes, or
    words joined by a space.
    """

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, doc, start, n, key, a, b in _occurrences(batches, spec):
            cols = [batch.column("anchors").flatten(), pa.array(key), pa.array(np.asarray(batch.column("row"))[doc]), pa.array(np.asarray(batch.column("doc"))[doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
            if with_content:
                raw = buf.tobytes()
                cut = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                cols += [pa.array(cut if not spec.words else [b" ".join(x.split()) for x in cut], pa.binary()), batch.column("cs").flatten()]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "key", "row", "doc", "start", "n", "content", "c"][: len(cols)])

    joined = docs.select("row", "doc", "text").join(lists, "row").select("row", "doc", "text", "starts", "counts", "anchors", *["cs"] * with_content)
    return joined.mapInArrow(cut_out, "anchor long, key long, row long, doc long, start int, n int" + ", content binary, c int" * with_content)


def window_keys(buf: np.ndarray, ws: np.ndarray, we: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run of ``size`` words from ``lo``, the same whatever white space stands between them."""
    used = np.unique(ranges(lo, size))
    words = np.zeros(len(ws), np.uint64)
    words[used] = span_hashes(buf, ws[used], we[used] - ws[used])
    out = size.astype(np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero(size > k)
        out[live] = mix(out[live] * U64(0x9E3779B97F4A7C15) + words[lo[live] + k] + U64(7))
    return out


#: An occurrence of a segment as tasks deal it.
PLACE = np.dtype([("anchor", "u1", 6), ("key", "<i8"), ("row", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("n", "u1")])


def earliest(anchor: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Index of the first place, by (doc, start, row), of each (anchor, key), in order of these."""
    order = np.lexsort((key, anchor))
    if not len(order):
        return order
    a, k = anchor[order], key[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])))
    size, best = np.diff(np.append(head, len(order))), np.ones(len(order), bool)
    for place in (doc, start, row):
        x = np.where(best, place[order].astype(np.int64), np.iinfo(np.int64).max)
        best &= x == np.repeat(np.minimum.reduceat(x, head), size)
    return order[best]


def firsts(docs: DataFrame, hits: DataFrame, spec: Spec, buckets: int) -> DataFrame:
    """(anchor, key, doc, start, row, n, c) of the first occurrence of each candidate segment, as a written table; ``c`` is the number of different ones of its anchor.

    Occurrences are dealt by anchor as packed arrays, of equal ones in a chunk of texts the first alone.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, of, start, n, key, *_ in _occurrences(batches, spec):
            anchor = np.asarray(batch.column("anchors").flatten()).view(np.uint64)
            row, doc = (np.asarray(batch.column(k))[of] for k in ("row", "doc"))
            i = earliest(anchor, key, doc, start, row)
            bucket = ((anchor[i] >> U64(8)) % U64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            i, bucket = i[by], bucket[by]
            rec = np.empty(len(i), PLACE)
            rec["anchor"] = np.ascontiguousarray(anchor[i]).view(np.uint8).reshape(-1, 8)[:, :6]
            for name, v in (("key", key), ("row", row), ("doc", doc), ("start", start), ("n", n)):
                rec[name] = v[i]
            head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(i) else np.zeros(0, np.int64)
            ends = (np.append(head, len(i)) * PLACE.itemsize).astype(np.int64)
            places = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(rec.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), places.cast(pa.binary())], names=["bucket", "places"])

    def meet(table: pa.Table) -> pa.Table:
        rec = np.frombuffer(flat(table.column("places"))[1], PLACE)
        anchor, cols = unpack(rec["anchor"].tobytes()), {k: rec[k] for k in ("key", "doc", "start", "row", "n")}
        i = earliest(anchor, *(cols[k] for k in ("key", "doc", "start", "row")))
        a = anchor[i]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(i) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(i)))
        kinds = {"key": np.int64, "doc": np.int64, "start": np.int32, "row": np.int64, "n": np.int32}
        return pa.table({"anchor": a.view(np.int64)} | {k: np.ascontiguousarray(cols[k][i], t) for k, t in kinds.items()} | {"c": np.repeat(size, size).astype(np.int32)})

    joined = docs.select("row", "doc", "text").join(hits, "row").select("row", "doc", "text", "starts", "counts", "anchors")
    sent = joined.mapInArrow(send, "bucket int, places binary")
    return written(sent.groupBy("bucket").applyInArrow(meet, "anchor long, key long, doc long, start int, row long, n int, c int"), "firsts")


def ambiguous(docs: DataFrame, first: DataFrame, spec: Spec, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, with content, whose anchor has other segments as well, as a written table; of these those of up to ``hot`` and those of more."""
    lists = first.where("c > 1").groupBy("row").agg(F.collect_list(F.struct("start", "n", "anchor", "c")).alias("x"))
    lists = lists.select("row", F.col("x.start").alias("starts"), F.col("x.n").alias("counts"), F.col("x.anchor").alias("anchors"), F.col("x.c").alias("cs"))
    found = written(_pieces(docs, lists, spec, True), "ambiguous")
    return found, found.where(F.col("c") <= hot), found.where(F.col("c") > hot)


def removed_runs(docs: DataFrame, hits: DataFrame, first: DataFrame, masks: DataFrame, spec: Spec, by_start: bool) -> DataFrame:
    """(row, starts, counts, own, gone) for each document with candidate segments.

    ``own`` are the starts of segments of which it has the first occurrence,
    ``gone`` the windows of each that start even earlier elsewhere; all other
    candidate segments in starts and counts have an earlier equal one (or, for
    ``runs_of`` to tell, an equal one in the same row).  A segment whose first
    occurrence is in another row of the same document (repeated or no ids) isn't
    later than it, or ``by_start`` only from a greater start: if not, it is in ``own`` too.
    """
    windows = F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    alone, several = first.where("c = 1"), first.where("c > 1")
    solved = several.join(masks, ["anchor", "key"], "left").unionByName(alone.withColumn("gone", F.lit(None).cast("array<int>")))
    mine = solved.select("row", F.struct("start", windows).alias("x"))
    again = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc")
    if again.limit(1).count():
        shared = docs.select("row", "doc", "text").join(again, "doc", "left_semi")
        there = solved.select("anchor", "key", F.col("doc").alias("_doc"), F.col("start").alias("_start"), F.col("row").alias("_row"), windows)
        same = _pieces(shared, hits, spec, False).join(there, ["anchor", "key"]).where((F.col("doc") == F.col("_doc")) & (F.col("row") != F.col("_row")))
        if by_start:
            same = same.where(F.col("start") == F.col("_start"))
        mine = mine.unionByName(same.select("row", F.struct("start", "gone").alias("x")))
    per = mine.groupBy("row").agg(F.collect_list("x").alias("x")).select("row", F.col("x.start").alias("own"), F.col("x.gone").alias("gone"))
    return hits.select("row", "starts", "counts").join(per, "row", "left")


def runs_of(batch: pa.RecordBatch, offsets: np.ndarray, spec: Spec, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths), in tokens of the whole batch, of what goes from its documents; columns as ``removed_runs`` gives them.

    With the bytes of the texts, equal segments further down in the same
    document aren't later than the first: they lose the same windows, not all.
    """

    def lists(name: str) -> tuple[np.ndarray, pa.Array]:
        column = batch.column(name)
        sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        return np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes), column.flatten()

    ints = lambda x: np.asarray(x).astype(np.int64)
    row, starts = lists("starts")
    starts, counts = ints(starts), ints(lists("counts")[1])
    mine, own = lists("own")
    own, windows = ints(own), lists("gone")[1]
    sizes = ints(windows.value_lengths()) if len(windows) else np.zeros(0, np.int64)
    lost, at = ints(windows.flatten()) if len(windows) else np.zeros(0, np.int64), np.cumsum(sizes) - sizes
    place, known = row << 32 | starts, mine << 32 | own
    whole = ~np.isin(place, known)
    goes = [(np.repeat(offsets[mine] + own, sizes) + lost, np.full(len(lost), spec.window, np.int64))]
    if buf is not None and len(own) and whole.any():
        content = span_hashes(buf, offsets[row] + starts, counts + spec.window - 1) ^ mix(row.astype(np.uint64))
        sort = np.argsort(place)
        of_own = content[sort[np.searchsorted(place, known, sorter=sort)]]
        sort = np.argsort(of_own, kind="stable")
        hit = np.minimum(np.searchsorted(of_own, content, sorter=sort), len(own) - 1)
        same = whole & (of_own[sort[hit]] == content)
        j, i = sort[hit[same]], np.flatnonzero(same)
        goes.append((np.repeat(offsets[row[i]] + starts[i], sizes[j]) + lost[ranges(at[j], sizes[j])], np.full(int(sizes[j].sum()), spec.window, np.int64)))
        whole &= ~same
    goes.append(((offsets[row] + starts)[whole], counts[whole] + spec.window - 1))
    return np.concatenate([x for x, _ in goes]), np.concatenate([x for _, x in goes])
