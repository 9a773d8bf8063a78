"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct word shingles; its signature the minimum of
each of ``COORDINATES`` hash functions over the set.  Two documents with
similarity s agree on Binomial(COORDINATES, s) coordinates: at 0.8 fewer than
``MATCHES`` of 64 agree with a probability of about 1e-7, more similar pairs are
safer still.  Candidates are pairs that agree on ``MATCHES`` coordinates.

Documents are posted under (coordinate, value) pairs.  A pair that one document
alone has can't match and is skipped; a document with fewer than ``MATCHES``
others drops out.  Two documents that agree on MATCHES coordinates share one of
the COORDINATES - MATCHES + 1 rarest of either, so only this prefix is posted
(rarest first, the same order for all).  Merging the lists counts collisions,
signatures settle the match, and the full shingle sets confirm each link.

Equal sets are one node from the start.  Of each listed node the shingles that no
other listed node has are counted: they are in no intersection, so a node with
more than 20 per cent of them (at a threshold of 80) is alone, and the rest bounds the intersection of
every pair before it is made.  In the last turn a pair is bounded by the shingles that more than ``RARE``
nodes have, and pairs that share a rarer one are found by lists of these, of ``RARE`` nodes at most.  No list is expanded into all of its
pairs: ``ROUNDS`` times each member is first compared with one pivot of its
lists (at first the most central), links join components, and what is left are pairs of different
components, of which a list gives those outside its largest component against
the whole list.  Pairs inside a component need no comparison, so none is lost.

Null and wordless documents have empty sets and are alone.  Rows without an id
come last; repeated rows are members of one component, of which ``keep_first`` keeps
one row.  Ties of signature values link like any others, and exact sets decide.
Texts may be of any length.  ``link`` reads id and text alone, ``keep_first`` passes
columns of any name through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.kernels import LOWER, SPACE, U64, flat, gram_hashes, mix, padded, span_hashes, text_chunks, word_spans
from larkspur.llm.tables import drop, unnested, written

COORDINATES, MATCHES, ROUNDS, RARE = 64, 34, 2, 64
_RANDOM = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _RANDOM[:COORDINATES], _RANDOM[COORDINATES:] | U64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in a row, offsets per text).

    A text with fewer words than ``size``, but not none, has its whole sequence as one shingle.
    """
    offsets, data = flat(column)
    low = LOWER[data]
    s, e, w = word_spans(offsets, low, SPACE)
    h = span_hashes(padded(low), s, e - s)
    n, count = len(w) - 1, np.diff(w)
    grams = gram_hashes(h, size)
    doc = np.repeat(np.arange(n), count)
    inside = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    docs, values = doc[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            ok = count[short] > k
            few[ok] = mix(few[ok] * U64(0x9E3779B97F4A7C15) + h[w[short[ok]] + k] + U64(k + 1))
        docs, values = np.concatenate([docs, short]), np.concatenate([values, few])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    docs, values = docs[new], values[new]
    return values, np.searchsorted(docs, np.arange(n + 1))


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint32, COORDINATES for each nonempty set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _TIMES[k], starts) >> U64(32)
    return out


def numbered(docs: DataFrame, key: str, text: str, rest: bool = False) -> tuple[DataFrame, bool]:
    """(row, doc, id, text and, if asked for, a struct of the other columns), and whether that is a table written for it.

    Ids that are all there and all different are the numbers of their rows.
    Else rows are numbered as they are read; that can differ from read to read,
    so they are written with their numbers, and all that is joined by those
    must be read from this table.
    """
    id = F.col(key).cast("long")  # noqa: A001
    odd = docs.groupBy(id.alias("id")).agg(F.count(F.lit(1)).alias("c")).where("id IS NULL OR c > 1").limit(1).count()
    row = F.monotonically_increasing_id() if odd else id
    others = [F.struct(*(c for c in docs.columns if c != text)).alias("rest")] if rest else []
    rows = docs.select(row.alias("row"), F.coalesce(id, F.lit((1 << 63) - 1)).alias("doc"), F.col(key).alias("id"), F.col(text).alias("text"), *others)
    return (written(rows, "numbered"), True) if odd else (rows, False)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(row, doc, id, n, s1, s2, sig) of every ``numbered`` row, as a written table; (s1, s2, n) stands for the set."""
    src = docs.select("row", "doc", "id", "text")
    kind = dict(src.dtypes)["id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            values, offsets = shingle_sets(batch.column("text"), size)
            n = np.diff(offsets)
            some = n > 0
            sums = np.zeros((2, batch.num_rows), np.uint64)
            sig: list = [None] * batch.num_rows
            if some.any():
                starts = offsets[:-1][some]
                sums[0, some] = np.add.reduceat(mix(values + U64(1)), starts)
                sums[1, some] = np.add.reduceat(mix(values ^ U64(0x5851F42D4C957F2D)), starts)
                for i, v in zip(np.flatnonzero(some).tolist(), signatures(values, offsets), strict=True):
                    sig[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), batch.column("id"), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sig, pa.binary())], names=["row", "doc", "id", "n", "s1", "s2", "sig"])

    return written(src.mapInArrow(read, f"row long, doc long, id {kind}, n long, s1 long, s2 long, sig binary"), "signatures")


def postings(nodes: DataFrame, matches: int) -> DataFrame:
    """(token, node, n, weight): each node under the rarest of its shared tokens, rarest first.

    The weight is the number of documents that share its tokens: the greatest in a group has what most of the group have.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (np.arange(COORDINATES, dtype=np.uint64) << U64(32))[None, :]
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                token = mix(sig.astype(np.uint64) | place).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), COORDINATES)), pa.array(token.ravel())], names=["node", "token"])

    tokens = written(nodes.select("node", "sig").mapInArrow(spread, "node long, token long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    joined = tokens.join(shared, "token")
    of = Window.partitionBy("node")
    ranked = joined.withColumn("own", F.count(F.lit(1)).over(of)).withColumn("weight", F.sum("df").over(of)).where(F.col("own") >= matches).withColumn("k", F.row_number().over(of.orderBy("df", "token")))
    prefix = ranked.where(F.col("k") <= F.col("own") - matches + 1).select("token", "node", "weight")
    found = written(prefix.join(nodes.select("node", "n"), "node"), "postings")
    drop(tokens)
    return found


def spread_shingles(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, alone, rare): how many shingles of a node no other node has, and how many ``RARE`` nodes at most;
    and, as a written table, (shingle, node) of those that at least two and at most ``RARE`` nodes have."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) >> 3 for x in batch.column("set").to_pylist()], np.int64)
            values = np.frombuffer(b"".join(batch.column("set").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), size)), pa.array(values)], names=["node", "shingle"])

    each = sets.select("node", "set").mapInArrow(spread, "node long, shingle long")
    few = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= RARE)
    listed = written(each.join(few, "shingle").select("shingle", "node", (F.col("c") == 1).alias("alone")), "shingles")
    counts = listed.groupBy("node").agg(F.count_if("alone").alias("alone"), F.count(F.lit(1)).alias("rare"))
    return counts, listed


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) that agree on enough coordinates and whose sets are similar enough, as a written table."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in ("sig_a", "sig_b"))
                ok = pa.array((x == y).sum(axis=1) >= matches)
                yield batch.select(["a", "b"]).filter(ok)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = []
                for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                    u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    ok.append(100 * both >= percent * (len(u) + len(v) - both))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    sig = nodes.select("node", "sig")
    side = lambda t, v, k: t.select(F.col("node").alias(k), F.col(v).alias(f"{v}_{k}"))
    near = pairs.join(side(sig, "sig", "a"), "a").join(side(sig, "sig", "b"), "b").mapInArrow(agree, "a long, b long")
    both = near.join(side(sets, "set", "a"), "a").join(side(sets, "set", "b"), "b")
    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(similar, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) with the smallest reachable node, by label propagation with pointer jumping; nodes in no link are left out."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        new = written(near.join(far, "comp", "left").select("node", "old", F.least("comp", "jump").alias("comp")), "labels")
        drop(labels)
        labels = new.select("node", "comp")
        if not new.where("old <> comp").limit(1).count():
            drop(both)
            return labels


def link(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", matches: int = MATCHES) -> DataFrame:
    """(row, id, n, component, first): the smallest id of each row's component, and whether the row is the component's first."""
    rows, own = numbered(docs, key, text)
    found = linked(rows, size, percent, matches)
    if own:
        drop(rows)
    return found


def linked(docs: DataFrame, size: int, percent: int, matches: int = MATCHES) -> DataFrame:
    """``link`` of ``numbered`` rows, as a written table; all tables on the way are deleted."""
    rows = signed(docs, size)
    heads = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "row")).alias("head"))
    nodes = written(rows.join(heads.select("head.row", F.col("head.doc").alias("_d")), "row").select(F.col("row").alias("node"), "doc", "n", "sig"), "nodes")
    listed = postings(nodes, matches)
    members = listed.select("node").distinct()
    texts = docs.select(F.col("row").alias("node"), "text").join(members, "node", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            values, offsets = shingle_sets(batch.column("text"), size)
            sets = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    sets = written(texts.mapInArrow(read, "node long, set binary"), "sets")
    counts, shingles = spread_shingles(sets)
    counted = listed.join(counts, "node", "left").withColumns({"both": F.col("n") - F.coalesce("alone", F.lit(0)), "often": F.col("n") - F.coalesce("rare", F.lit(0))})
    # A link needs ``percent`` of a node's shingles in another node.
    posted = written(counted.where(F.col("both") * 100 >= F.col("n") * percent).select("token", "node", "n", "weight", "both", "often"), "posted")
    drop(listed)
    links, comps = [], None
    ordered = lambda met: met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    for turn in range(ROUNDS + 1):
        if comps is None:
            lists = posted.withColumn("comp", F.col("node"))
        else:
            lists = written(posted.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "lists")
            drop(comps)
        # Two sets share at most what the smaller ``both`` has.
        fits = lambda x, y, of="both": F.least(F.col(f"{x}.{of}"), F.col(f"{y}.{of}")) * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent
        if turn < ROUNDS:
            # First the node that has most in common with all others, then the one with the least of its own.
            first = [-F.col("weight"), -F.col("both") / F.col("n")][min(turn, 1)]
            order = F.struct(first.alias("h"), (-F.col("weight")).alias("w"), "node", "n", "both", "comp")
            pivot = lists.groupBy("token").agg(F.min(order).alias("p")).select("token", "p.node", "p.n", "p.both", "p.comp")
            met = lists.alias("x").join(pivot.alias("y"), "token").where((F.col("x.comp") != F.col("y.comp")) & fits("x", "y")).groupBy(F.col("x.node").alias("x"), F.col("y.node").alias("y")).agg(F.count(F.lit(1)).alias("c"))
            best = met.groupBy("x").agg(F.max(F.struct("c", (-F.col("y")).alias("y"))).alias("b")).select("x", (-F.col("b.y")).alias("y"))
            pairs = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        else:
            share = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
            largest = share.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.col("top.comp").alias("top"))
            several = lists.join(largest, "token")
            outside = several.where("comp <> top")
            apart = F.col("x.comp") != F.col("y.comp")
            # Pairs without a rare shingle in common share at most what the smaller ``often`` has; the others meet at a rare shingle.
            met = outside.alias("x").join(several.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & fits("x", "y", "often") & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))))
            about = lists.select("node", "n", "both", "comp").distinct()
            rare = shingles.where("NOT alone").select("shingle", "node")
            left = rare.join(outside.select("node", "n", "both", "comp").distinct(), "node")
            right = rare.join(left.select("shingle").distinct(), "shingle", "left_semi").join(about, "node")
            meeting = left.alias("x").join(right.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & fits("x", "y"))
            pairs = ordered(met).union(ordered(meeting))
        links.append(confirmed(pairs.distinct(), nodes, sets, matches, percent))
        if comps is not None:
            drop(lists)
        comps = components(reduce(DataFrame.unionByName, links))
    names = nodes.select("node", "doc")
    least = comps.join(names, "node").groupBy("comp").agg(F.min(F.struct("doc", "node")).alias("least"))
    final = comps.join(least, "comp").select("node", "least")
    of = rows.join(heads.select("s1", "s2", "n", "head"), ["s1", "s2", "n"], "left").withColumn("node", F.col("head.row"))
    done = of.join(final, "node", "left")
    component = F.when(F.col("n") == 0, F.struct("doc", F.col("row").alias("node"))).otherwise(F.coalesce("least", F.struct(F.col("head.doc").alias("doc"), F.col("head.row").alias("node"))))
    told = done.select("row", "id", "doc", "n", component.alias("c")).select("row", "id", "n", F.when(F.col("c.doc") < (1 << 63) - 1, F.col("c.doc")).alias("component"), (F.col("row") == F.col("c.node")).alias("first"))
    told = written(told, "components")
    drop(rows, nodes, posted, sets, shingles, comps, *links)
    return told


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates of others: of each component the row with the smallest id stays."""
    rows, _ = numbered(docs, key, text, rest=True)
    stay = linked(rows, size, percent).where("first").select("row")
    return unnested(rows.join(stay, "row", "left_semi"), docs.columns, text)


#: DuckDB SQL of the query over ``documents``, with all pairs that share a shingle and the closure of the links: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * pair.n >= 80 * (x.n + y.n - pair.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN c USING (doc_id)
"""
