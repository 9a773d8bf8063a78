"""Merkle manifest of a dataset: one tree per group over its ordered leaves, and one tree over the groups.

``H`` is the lowercase hex sha256 of the concatenated inputs.  While a tree has
several nodes on a level, every ``FANOUT`` consecutive ones become their H (the
last run may be shorter, down to one; nothing is padded).  A lone leaf is its
own root.  The roots of all groups, ordered by group (null first, then by UTF-8
bytes), are the leaves of the last tree.

Leaves are sorted by Spark into indexed partitions of about ``ROWS``; sizes of
the runs at the edges of partitions, one row each, tell where in its group every
partition starts.  ``Range`` is the mountain range of a stretch of leaves: a
stack onto which nodes are pushed from the left; a run of ``FANOUT`` complete
siblings is carried into its parent, as a digit in that base is, and the short
runs at the end of a group are closed once its size is known.  What is left is
the stretch's peaks, at most two times ``FANOUT`` - 1 on a level.  Peaks of
``WIDE`` neighbouring partitions meet in one task and go through the same stack,
and so on until every group has its root: unaligned edges are merged by the
partitions' numbers, a few thousand nodes in a task.  The way back down
hands each peak the siblings above it, so a leaf's proof needs no join by level.

Defined cases: null fields are written as ``-``; groups and ids may be null (they
sort first); rows of one id are leaves of their own, ordered by their hash, and
equal rows get the places of their run in any order; texts of any length are
hashed in the JVM.  An empty table gives an empty manifest.  Columns other than
the named ones aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.tables import written

FANOUT = 3
#: Leaves in a partition, about; partitions whose peaks meet in one task.
ROWS, WIDE = 16_384, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def join_hash(parts: list[str]) -> str:
    """H of nodes."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of fields: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (x.cast("string") for x in fields)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


@dataclass
class Node:
    level: int
    index: int  #: place on its level
    hash: str
    above: Node | None = None
    step: tuple[str, str] = ("", "")  #: the run's others, left and right of this one
    path: str | None = None  #: for a peak: the steps above it


@dataclass
class Range:
    """The mountain range of a stretch of neighbouring nodes of one group."""

    stack: list[Node] = field(default_factory=list)
    made: list[Node] = field(default_factory=list)

    def _carry(self, k: int) -> None:
        """The last k of the stack become their parent."""
        run = self.stack[-k:]
        hashes = [n.hash for n in run]
        parent = Node(run[0].level + 1, run[0].index // FANOUT, join_hash(hashes))
        for i, n in enumerate(run):
            n.above, n.step = parent, ("".join(hashes[:i]), "".join(hashes[i + 1 :]))
        del self.stack[-k:]
        self.stack.append(parent)
        self.made.append(parent)

    def _whole(self, k: int) -> bool:
        """Whether the last k of the stack are siblings, from the first child on."""
        run = self.stack[-k:]
        return len(run) == k and run[0].index % FANOUT == 0 and all(n.level == run[0].level and n.index == run[0].index + i for i, n in enumerate(run))

    def push(self, node: Node) -> None:
        self.stack.append(node)
        while self.stack[-1].index % FANOUT == FANOUT - 1 and self._whole(FANOUT):
            self._carry(FANOUT)

    def finish(self, leaves: int) -> None:
        """Closes the short runs: the group has this many leaves, and the last node ends with them."""
        level, nodes = 0, leaves
        while nodes > 1:
            last = self.stack[-1]
            if last.level == level:
                k = last.index % FANOUT + 1
                if not self._whole(k):
                    return  # the run began in another stretch
                self._carry(k)
            level, nodes = level + 1, -(-nodes // FANOUT)

    def complete(self, leaves: int) -> bool:
        return len(self.stack) == 1 and self.stack[0].index == 0 and FANOUT ** self.stack[0].level >= leaves


def steps(node: Node) -> str:
    """The siblings from this node to the root: steps parted by commas, the node's own place marked by a point."""
    own = []
    while node.above is not None:
        own.append(".".join(node.step))
        node = node.above
    if node.path:
        own.append(node.path)
    return ",".join(own)


def siblings(path: str) -> str:
    return path.replace(",", "").replace(".", "")


def refold(start: str, path: str) -> str:
    """The root that a leaf and the siblings of its path give."""
    for step in path.split(",") if path else ():
        left, right = step.split(".")
        start = hashlib.sha256((left + start + right).encode()).hexdigest()
    return start


#: A stretch's rows: partition, group, level and place of a node, its hash and, on a group's last one, the group's size.
PEAK = "part long, grp string, level int, place long, hash string, leaves long"
#: Peaks that are left (0), roots of groups (1), all other nodes that a round has made (2).
UP = "kind int, " + PEAK
#: What lies above a peak.
DOWN = "part long, grp string, level int, place long, path string, subroot string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def arrow(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")]))


def stretches(rows: list[dict]) -> Iterator[tuple[str | None, list[dict]]]:
    """Neighbouring rows of equal group."""
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i]["grp"] != rows[lo]["grp"]:
            yield rows[lo]["grp"], rows[lo:i]
            lo = i


def placed(table: pa.Table) -> list[dict]:
    """A partition of leaves in order, each with its place in its group and, on a group's last one, the group's size."""
    rows = sorted(table.to_pylist(), key=lambda r: r["at"])
    for k, (_, run) in enumerate(stretches(rows)):
        for i, r in enumerate(run, run[0]["start"] if k == 0 else 0):
            r["level"], r["place"], r["leaves"] = 0, i, None
        if run[-1] is not rows[-1] or not run[-1]["goes_on"]:
            run[-1]["leaves"] = run[-1]["place"] + 1
    return rows


def in_order(table: pa.Table) -> list[dict]:
    """Peaks by group (null first, by bytes) and first leaf; no two of them overlap."""
    return sorted(table.to_pylist(), key=lambda r: (r["grp"] is not None, (r["grp"] or "").encode(), r["place"] * FANOUT ** r["level"]))


def ranges(rows: list[dict]) -> Iterator[tuple[list[dict], list[Node], Range]]:
    """(rows, their nodes, the range that they make) of each stretch."""
    for _, run in stretches(rows):
        made, nodes = Range(), [Node(r["level"], r["place"], r["hash"]) for r in run]
        for n in nodes:
            made.push(n)
        if run[-1]["leaves"] is not None:
            made.finish(run[-1]["leaves"])
        yield run, nodes, made


def climbed(rows: list[dict]) -> pa.Table:
    """(UP) of a task's stretches."""
    out = []
    for run, _, made in ranges(rows):
        leaves, part, group = run[-1]["leaves"], run[0]["part"], run[0]["grp"]
        root = leaves is not None and made.complete(leaves)
        out += [{"kind": int(root), "part": part, "grp": group, "level": n.level, "place": n.index, "hash": n.hash, "leaves": leaves if n is made.stack[-1] else None} for n in made.stack]
        out += [{"kind": 2, "part": part, "grp": group, "level": n.level, "place": n.index, "hash": n.hash, "leaves": None} for n in made.made if n.above is not None]
    return arrow(out, UP)


def descended(rows: list[dict], above: pa.Table) -> Iterator[tuple[dict, str, str]]:
    """Each row with its path to the root and its group's root."""
    known = {(r["grp"], r["level"], r["place"]): (r["path"], r["subroot"]) for r in above.to_pylist()}
    for run, nodes, made in ranges(rows):
        for n in made.stack:
            n.path, subroot = known[run[0]["grp"], n.level, n.index]
        for r, n in zip(run, nodes, strict=True):
            yield r, steps(n), subroot


@dataclass
class Tree:
    """The tree of every group: a written table of ordered leaves, and one of nodes for each round up."""

    leaves: DataFrame
    rounds: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(grp, hash), one row for each group."""
        return reduce(DataFrame.union, (r.where("kind = 1").select("grp", "hash") for r in self.rounds))

    @property
    def nodes(self) -> DataFrame:
        """Every node above the leaves once: (grp, level, place, hash)."""
        found = reduce(DataFrame.union, (r.where("level > 0").select("grp", "level", "place", "hash") for r in self.rounds))
        return found.distinct()  # a peak stays in the rounds until it is carried

    def finished(self, tops: DataFrame, make: Callable[[dict, str, str], dict], schema: str) -> DataFrame:
        """``make(leaf's row, path to the root, group's root)`` of every leaf; ``tops`` has what lies above each group: (grp, path)."""
        found = None
        for k in range(len(self.rounds) - 1, -1, -1):
            # One row for each group on either side.
            done = self.rounds[k].where("kind = 1").alias("u").join(tops.alias("t"), F.col("u.grp").eqNullSafe(F.col("t.grp")))
            done = done.select("u.part", "u.grp", "u.level", "u.place", "t.path", F.col("u.hash").alias("subroot"))
            found = done if found is None else done.union(found)
            if k:
                found = written(_together(self.rounds[k - 1].where("kind = 0"), found, WIDE**k, _down, DOWN), "merkle-down")

        def leaves(rows: pa.Table, above: pa.Table) -> pa.Table:
            return arrow([make(*x) for x in descended(placed(rows), above)], schema)

        return _together(self.leaves, found, 1, leaves, schema)


def _together(rows: DataFrame, above: DataFrame, wide: int, run: Callable, schema: str) -> DataFrame:
    """Rows and what is above them, by partitions that were joined ``wide`` at a time."""
    by = lambda df: df.withColumn("wide", F.floor(F.col("part") / wide)).groupBy("wide")
    return by(rows).cogroup(by(above)).applyInArrow(lambda a, b: run(a.drop(["wide"]), b.drop(["wide"])), schema)


def _down(rows: pa.Table, above: pa.Table) -> pa.Table:
    found = descended(in_order(rows), above)
    return arrow([{"part": r["part"], "grp": r["grp"], "level": r["level"], "place": r["place"], "path": p, "subroot": s} for r, p, s in found], DOWN)


def indexed(rows: DataFrame, order: list[str], rows_each: int) -> DataFrame:
    """Rows (grp, hash, ...) sorted into partitions and written, with part and at (the place in it), start and goes_on.

    start: how many leaves of the partition's first group lie in earlier partitions; goes_on: whether its last group has more in later ones.
    """
    parts = max(1, -(-rows.count() // rows_each))
    by = [*(F.col(c).asc_nulls_first() for c in ("grp", *order)), F.col("hash"), F.col("salt")]  # the salt parts equal rows
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("salt")
    dealt = dealt.withColumns({"part": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = written(dealt, "merkle-leaves")
    run = F.struct(F.sha2(F.col("grp").cast("binary"), 256).alias("grp"), "n")
    runs = dealt.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"))
    edges = runs.groupBy("part").agg(F.min_by(run, "lo").alias("head"), F.max_by(run, "lo").alias("tail"), F.count(F.lit(1)).alias("runs")).orderBy("part").collect()
    known, held, last = [], 0, None
    for e in edges:  # one row for each partition
        joined = last is not None and last["tail"]["grp"] == e["head"]["grp"]
        if joined:
            known[-1][2] = True
        start = held if joined else 0
        known.append([e["part"], start, False])
        held, last = e["tail"]["n"] + (start if e["runs"] == 1 else 0), e
    info = rows.sparkSession.createDataFrame(known, "part long, start long, goes_on boolean")
    return dealt.join(F.broadcast(info), "part")


def tree(rows: DataFrame, order: list[str], rows_each: int = ROWS) -> Tree:
    """The tree of every group of rows (grp, hash, ...)."""
    leaves = indexed(rows, order, rows_each)
    up = leaves.select("part", "at", "grp", "hash", "start", "goes_on").groupBy("part").applyInArrow(lambda t: climbed(placed(t)), UP)
    rounds, wide = [written(up, "merkle-up")], WIDE
    while not (left := rounds[-1].where("kind = 0").drop("kind")).isEmpty():
        at = F.floor(F.col("part") / wide)
        rounds.append(written(left.groupBy(at).applyInArrow(lambda t: climbed(in_order(t)), UP), "merkle-up"))
        wide *= WIDE
    return Tree(leaves, rounds)


@dataclass
class Manifest:
    """The tree of every group, the tree over the groups, and its root (null without rows)."""

    groups: Tree
    top: Tree
    root: str | None

    def finished(self, make: Callable[[dict, str, str], dict], schema: str) -> DataFrame:
        """``make(leaf's row, path to the root of all, group's root)`` of every leaf."""
        start = self.top.roots.select("grp", F.lit("").alias("path"))
        tops = self.top.finished(start, lambda r, path, _: {"grp": r["name"], "path": path}, "grp string, path string")
        return self.groups.finished(written(tops, "merkle-tops"), make, schema)


def build(rows: DataFrame, order: list[str], rows_each: int = ROWS) -> Manifest:
    """Trees over rows (grp, hash, and what else ``Manifest.finished`` is to read), each group ordered by ``order``."""
    groups = tree(rows, order, rows_each)
    top = tree(groups.roots.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "hash"), ["name"], rows_each)
    root = top.roots.first()
    return Manifest(groups, top, root["hash"] if root else None)


def tampered(id: str, text: str) -> Column:  # noqa: A002
    """The text without line feeds where 2 divides the checksum of the id."""
    return F.when(F.crc32(F.col(id).cast("string").cast("binary")) % 2 == 0, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))


def verify(docs: DataFrame, fields: tuple[str, ...] = FIELDS, rows_each: int = ROWS) -> DataFrame:
    """Leaf, roots and proof of every row, and whether the proof holds for the row as ``tampered`` leaves it.

    ``fields`` are those of a leaf: first the id (an integer), second the group, last the text.
    """
    key, group, text = fields[0], fields[1], fields[-1]
    own = [F.col(c) for c in fields[:-1]]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(group).cast("string").alias("grp"), leaf(*own, F.col(text)).alias("hash"), leaf(*own, tampered(key, text)).alias("other"))
    whole = build(written(rows, "merkle-hashed"), ["key"], rows_each)

    def proof(r: dict, path: str, subroot: str) -> dict:
        return {"doc_id": r["key"], "leaf": r["hash"], "subroot": subroot, "proof_sha256": join_hash([siblings(path)]), "folded_root": refold(r["other"], path)}

    found = whole.finished(proof, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(whole.root).cast("string")
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


#: The same in DuckDB, by recursion over levels; for ids that don't repeat.
SQL = """WITH RECURSIVE hashed AS (SELECT *, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
        CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS front,
        list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
    leaves AS (SELECT doc_id, source, sha256(concat(front, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
        CASE WHEN crc % 2 = 0 THEN text ELSE replace(text, chr(10), '') END AS other, front, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
    tree AS (SELECT source, 0 AS l, i, leaf AS h, n FROM leaves UNION ALL
        SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, l, i // 3, n),
    subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
    top AS (SELECT 0 AS l, i, h, n FROM subroots UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3, n),
    step AS (SELECT a.source, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
        FROM tree a JOIN tree b ON a.source IS NOT DISTINCT FROM b.source AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.l, a.i),
    top_step AS (SELECT a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
        FROM top a JOIN top b ON a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.l, a.i),
    fold AS (SELECT doc_id, source, 0 AS l, i, sha256(concat(front, CASE WHEN other IS NULL THEN '-' ELSE concat(strlen(other), ':', other) END)) AS h, '' AS proof, n FROM leaves UNION ALL
        SELECT f.doc_id, f.source, f.l + 1, f.i // 3, sha256(concat(s.lo, f.h, s.hi)), concat(f.proof, s.lo, s.hi), (f.n + 2) // 3 FROM fold f JOIN step s ON f.source IS NOT DISTINCT FROM s.source AND f.l = s.l AND f.i = s.i WHERE f.n > 1),
    top_fold AS (SELECT f.doc_id, 0 AS l, r.i, f.h, f.proof, r.n FROM fold f JOIN subroots r ON f.source IS NOT DISTINCT FROM r.source WHERE f.n = 1 UNION ALL
        SELECT f.doc_id, f.l + 1, f.i // 3, sha256(concat(s.lo, f.h, s.hi)), concat(f.proof, s.lo, s.hi), (f.n + 2) // 3 FROM top_fold f JOIN top_step s ON f.l = s.l AND f.i = s.i WHERE f.n > 1)
    SELECT v.doc_id, v.leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM leaves v JOIN subroots r ON v.source IS NOT DISTINCT FROM r.source JOIN top t ON t.n = 1 JOIN top_fold f ON f.doc_id IS NOT DISTINCT FROM v.doc_id AND f.n = 1"""
