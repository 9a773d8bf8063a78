"""Suffix-array dedup of byte strings by distributed prefix doubling.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller id.  ``segments`` drops the positions that can't repeat
(their anchor is unique) and collapses equal stretches.  What is left are
stretches that share an anchor but differ somewhere; their positions are sorted
by pairs (rank, rank at an offset) of growing depth 8, 16, 32 and ``WINDOW``,
and reranked, until they are unique or past the threshold:

* anchors with up to ``HOT`` different stretches go to shards (Spark deals and
  sorts by anchor), each of which sorts the pairs of its own positions;
* the stretches of more common anchors (edges of lines that many texts have) are
  cut again by longer anchors (``FINER``), most of which are unique or have equal
  stretches; what is left goes to shards as well;
* the pairs of anchors that are as common after that are sorted by Spark over all
  tasks, by range of the pair, so no anchor's positions have to fit one task.

Null and empty texts have no bytes.  Repeated rows (same id) aren't smaller
than each other and remove nothing from each other; rows without an id come
last.  Matches never cross documents.  Texts may be of any length.  Of equal
strings those of the smallest id stay.  ``dedup`` reads id and text alone,
``cut_column`` passes columns of any name through; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.kernels import U64, combine, flat, padded, ranges, removal_mask, span_hashes, text_chunks, words64
from larkspur.llm.segments import Spec, ambiguous, cut, firsts, removed_runs, repeated_anchors, runs_of, stored
from larkspur.llm.tables import drop, unnested, written

WINDOW, GRAM, HOT = 50, 24, 5_000
SPEC = Spec(WINDOW, GRAM, words=False)
#: For stretches of hot anchors: at most five windows share so long an anchor, so few different stretches do.
FINER = Spec(WINDOW, 46, words=False)
DEPTHS = (8, 16, 32, WINDOW)
#: Bytes of stretches in a shard: a task's arrays take about 60 times as much.
SHARD_BYTES = 2 << 20


def ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the keys, and whether each is unique."""
    order = np.argsort(key)
    k = key[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.uint64)
    rank[order] = np.cumsum(head).astype(np.uint64)
    last = np.append(head[1:], True)
    single = np.empty(len(k), bool)
    single[order] = head & last
    return rank, single


def doubled(offsets: np.ndarray, data: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window offset) of the windows that also lie in a stretch with a smaller owner.

    Prefix doubling over the positions of one shard: a window is out as soon as
    any rank inside it is unique.
    """
    n = len(data)
    seg = np.repeat(np.arange(len(counts)), counts)
    at = ranges(offsets[:-1], counts)
    rank, depth = words64(padded(data))[:n].byteswap(), 0
    for deeper in DEPTHS:
        # Ranks are needed where a window's strings of this depth start: everywhere in it, or at both its ends once two cover it.
        inner = range(WINDOW - deeper + 1) if 2 * deeper < WINDOW else (0, WINDOW - deeper)
        needed = np.zeros(n, bool)
        for k in inner if depth else ():
            needed[at + k] = True
        spots = np.flatnonzero(needed) if depth else np.arange(n)
        new, alone = ranks((rank[spots] << U64(32)) | rank[spots + deeper - depth]) if depth else ranks(rank)
        rank, single = np.zeros(n, np.uint64), np.zeros(n, bool)
        rank[spots], single[spots] = new, alone
        if 2 * deeper < WINDOW:
            total = np.concatenate([[0], np.cumsum(single)])
            out = total[at + WINDOW - deeper + 1] > total[at]
        else:
            out = single[at] | single[at + WINDOW - deeper]
        at, seg, depth = at[~out], seg[~out], deeper
        if not len(at):
            return seg, at
    r = rank[at]
    order = np.lexsort((owner[seg], r))
    head = np.ones(len(r), bool)
    head[1:] = r[order][1:] != r[order][:-1]
    least = owner[seg[order]][np.flatnonzero(head)][np.cumsum(head) - 1]
    gone = order[owner[seg[order]] > least]
    return seg[gone], at[gone] - offsets[seg[gone]]


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of batches that are sorted by the key, each with all rows of its keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.asarray(table.column(key))
            whole = int(np.searchsorted(keys, keys[-1], "left"))
            if whole:
                yield table.slice(0, whole)
                held = table.slice(whole).to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _local(segs: DataFrame) -> DataFrame:
    """(anchor, key, gone) by prefix doubling inside shards of whole anchors."""
    total = segs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(6, -(-int(total) // SHARD_BYTES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, "anchor", 2 * SHARD_BYTES):
            yield from solve(table)

    def solve(table: pa.Table) -> list[pa.RecordBatch]:
        if not table.num_rows:
            return []
        offsets, data = flat(table.column("content"))
        owner = np.asarray(table.column("doc"))
        seg, off = doubled(offsets, data, np.asarray(table.column("n")).astype(np.int64), owner)
        order = np.lexsort((off, seg))
        seg, off = seg[order], off[order]
        head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        rows = table.take(pa.array(seg[head]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(seg)), pa.int32()), pa.array(off.astype(np.int32)))
        return pa.table([rows.column("anchor"), rows.column("key"), lists], names=["anchor", "key", "gone"]).to_batches()

    dealt = segs.select("anchor", "key", "doc", "n", "content").repartition(shards, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(work, "anchor long, key long, gone array<int>")


def spark_ranks(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the rank of the keys: Spark sorts by range, ranks count on within a partition and grow with its number."""
    schema = rows.select("*", F.lit(0).cast("long").alias(out)).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rank, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)) for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            new[0] = last != tuple(c[0] for c in cols)
            last = tuple(c[-1] for c in cols)
            found = rank + np.cumsum(new)
            rank = int(found[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, out])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema)


def by_spark_sort(segs: DataFrame) -> DataFrame:
    """(anchor, key, gone) by prefix doubling over rows, sorted by Spark; any anchor may have any number of stretches."""
    eight = F.expr("conv(hex(substring(content, p + 1, 8)), 16, -10)").cast("long")
    rows = (
        segs.select("anchor", "key", F.col("doc").alias("owner"), "n", "content", F.explode(F.sequence(F.lit(0), F.col("n") + WINDOW - 1 - 8)).alias("p"))
        .select("anchor", "key", "owner", "n", "p", eight.alias("r"))
    )
    within = Window.partitionBy("anchor", "key").orderBy("p")
    for depth, deeper in zip(DEPTHS[:-1], DEPTHS[1:], strict=True):
        step = deeper - depth
        pairs = rows.withColumn("r2", F.lead("r", step).over(within)).where(F.col("p") + deeper <= F.col("n") + WINDOW - 1)
        rows = spark_ranks(pairs, ["r", "r2"], "rank").select("anchor", "key", "owner", "n", "p", F.col("rank").alias("r"))
        deep = written(rows, f"depth{deeper}")  # the next depth reads it by stretch again
        if depth > DEPTHS[0]:
            drop(last)
        rows = last = deep
    least = rows.groupBy("r").agg(F.min("owner").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("r", "least")
    return rows.join(least, "r").where("owner > least").groupBy("anchor", "key").agg(F.array_sort(F.collect_list("p")).alias("gone"))


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys is the first with its values."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return head


def finer(segs: DataFrame) -> DataFrame:
    """The stretches cut again by longer anchors, as a written table: (anchor, key) of the stretch, start in it and n of
    each piece that loses windows or may lose some.

    A piece with an equal one of a smaller owner loses all its windows: ``fine``
    is null.  Others stand here if their longer anchor has ``c`` > 1 different pieces:
    (fine, fkey), and once for each of these doc and content, for doubling.
    """
    total = segs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(6, -(-int(total) // SHARD_BYTES))
    sent = "fine long, fkey long, anchor long, key long, doc long, start int, n int, content binary"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "content"):
            grams, offsets, buf, *_ = FINER.tokens(batch.column("content"))
            at, n, gram = cut(grams, offsets, FINER)
            of = np.searchsorted(offsets, at, "right") - 1
            anchor, key, doc = (np.asarray(batch.column(k))[of] for k in ("anchor", "key", "doc"))
            fine = combine(gram, anchor.view(np.uint64)).view(np.int64)
            fkey = span_hashes(buf, at, n + WINDOW - 1).view(np.int64)
            order = np.lexsort((doc, fkey, fine))
            head = _heads(fine[order], fkey[order])
            later = np.zeros(len(at), bool)
            later[order] = doc[order] > doc[order][head][np.cumsum(head) - 1]
            fine[later] = key[later]  # settled here: any task will do
            raw, ends = buf.tobytes(), at + n + WINDOW - 1
            content = [None if gone else raw[a:b] for a, b, gone in zip(at.tolist(), ends.tolist(), later.tolist(), strict=True)]
            cols = [*map(pa.array, (fine, fkey, anchor, key, doc, (at - offsets[of]).astype(np.int32), n.astype(np.int32))), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["fine", "fkey", "anchor", "key", "doc", "start", "n", "content"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, "fine", 8 * SHARD_BYTES):
            open_ = np.asarray(table.column("content").is_valid())
            fine, fkey, doc = (np.asarray(table.column(k)) for k in ("fine", "fkey", "doc"))
            order = np.flatnonzero(open_)
            order = order[np.lexsort((doc[order], fkey[order], fine[order]))]
            head, new = _heads(fine[order], fkey[order]), _heads(fine[order])
            c = np.add.reduceat(head, np.flatnonzero(new), dtype=np.int32)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int32)
            later = doc[order] > doc[order][head][np.cumsum(head) - 1]
            shown = later | (c > 1)
            gone = np.append(np.flatnonzero(~open_), order[later])
            rest, first = order[shown & ~later], head[shown & ~later]
            rows = table.take(pa.array(np.append(gone, rest)))
            null = np.append(np.ones(len(gone), bool), np.zeros(len(rest), bool))
            bare = np.append(np.ones(len(gone), bool), ~first)
            counts = np.append(np.zeros(len(gone), np.int32), c[shown & ~later])
            found = [rows.column(k) for k in ("anchor", "key", "start", "n")]
            found += [pa.array(fine[np.append(gone, rest)], mask=null), rows.column("fkey"), rows.column("doc"), pa.array(counts), pa.compute.if_else(pa.array(bare), pa.scalar(None, pa.binary()), rows.column("content"))]
            yield from pa.table(found, names=["anchor", "key", "start", "n", "fine", "fkey", "doc", "c", "content"]).to_batches()

    pieces = segs.select("anchor", "key", "doc", "content").mapInArrow(cut_up, sent).repartition(shards, "fine").sortWithinPartitions("fine")
    return written(pieces.mapInArrow(meet, "anchor long, key long, start int, n int, fine long, fkey long, doc long, c int, content binary"), "finer")


def crowded(segs: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, key, gone) of stretches of common anchors, and the table that it reads."""
    pieces = finer(segs)
    distinct = pieces.where("content IS NOT NULL").select(F.col("fine").alias("anchor"), F.col("fkey").alias("key"), "doc", "n", "content", "c")
    masks, many = _local(distinct.where(F.col("c") <= hot)), distinct.where(F.col("c") > hot)
    if many.limit(1).count():
        masks = masks.unionByName(by_spark_sort(many))
    masks = masks.select(F.col("anchor").alias("fine"), F.col("key").alias("fkey"), "gone")
    some = pieces.join(masks, ["fine", "fkey"]).select("anchor", "key", F.transform("gone", lambda x: x + F.col("start")).alias("gone"))
    every = pieces.where("fine IS NULL").select("anchor", "key", F.sequence("start", F.col("start") + F.col("n") - 1).alias("gone"))
    return some.unionByName(every).groupBy("anchor", "key").agg(F.array_sort(F.flatten(F.collect_list("gone"))).alias("gone")), pieces


def duplicates(docs: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """(row, starts, counts, own, gone): see ``removed_runs``."""
    hits = repeated_anchors(docs, SPEC, n)
    first = firsts(docs, hits, SPEC, n)
    found, few, many = ambiguous(docs, first, SPEC, hot)
    masks, used = _local(few), [found]
    if many.limit(1).count():
        more, pieces = crowded(many, hot)
        masks = masks.unionByName(more)
        used.append(pieces)
    masks = written(masks, "masks")
    drop(*used)
    runs = written(removed_runs(docs, hits, first, masks, SPEC, by_start=False), "runs")
    drop(hits, first, masks)
    return runs


def kept_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(bytes, removed bytes, removed runs, what is left) of each text."""
    offsets, data = flat(batch.column("text"))
    gone = removal_mask(len(data), *runs_of(batch, offsets, SPEC, padded(data)))
    before = np.concatenate([[0], np.cumsum(gone)])
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    head[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]  # runs end with their text
    starts = np.concatenate([[0], np.cumsum(head)])
    left = data[~gone].tobytes()
    ends = (offsets - before[offsets]).tolist()
    return np.diff(offsets), np.diff(before[offsets]), np.diff(starts[offsets]), [left[a:b] for a, b in zip(ends, ends[1:], strict=False)]


RESULT = "id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(corpus: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: id, sizes, digest and (``with_text``) the bytes that stay, as a string.

    A cut can fall inside a character; in the string, not in the digest, the
    broken pieces of such a character are left out.
    """
    docs, n = stored(corpus, "suffix", key, text)
    joined = docs.select("row", "id", "text").join(duplicates(docs, n, hot), "row", "left").drop("row")
    kind = dict(docs.dtypes)["id"]
    schema = RESULT.format(id=kind) + (", kept string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            size, gone, spans, kept = kept_bytes(batch)
            cols = [batch.column("id"), *(pa.array(x.astype(np.int64)) for x in (size, gone, spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, schema)


def cut_column(corpus: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """The frame with the repeated strings cut out of its text; all other columns stay, null texts stay null.

    Pieces of a character that a cut has left are left out.
    """
    docs, n = stored(corpus, "suffix", key, text, rest=True)
    joined = docs.select("row", "rest", "text").join(duplicates(docs, n, hot), "row", "left").drop("row")
    schema = docs.select("rest", "text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            kept = [x.decode("utf-8", "ignore") for x in kept_bytes(batch)[3]]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(kept, pa.string())], names=["rest", "text"])

    done = joined.mapInArrow(cut, schema).withColumn("text", F.when(~F.col("rest.no_text"), F.col("text")))
    return unnested(done.select(F.col("rest.of").alias("rest"), "text"), corpus.columns, text)


#: DuckDB SQL of the whole query over ``documents``: texts as hexadecimal digits, two for each byte, in blocks with 49 bytes of overlap.
SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
block AS (SELECT doc_id, b, substr(h, 8192 * b + 1, 8290) AS h FROM (SELECT *, unnest(range(0, (n + 4046) // 4096)) AS b FROM d WHERE n >= 50)),
win AS (SELECT doc_id, 4096 * b + i AS i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT *, unnest(range(0, least(4096, len(h) // 2 - 49))) AS i FROM block)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM win JOIN least_doc USING (k) WHERE m < doc_id),
head AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM head) GROUP BY doc_id, r),
piece AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM run),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_gone, count(*) AS spans FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
