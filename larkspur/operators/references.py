"""Foreign keys: what deletions and renames of keys mean for the tables that refer to them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.changes import unique


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent.key``; what happens to a child of a deleted row: cascade, null or restrict."""

    child: str
    column: str
    parent: str
    key: str
    action: str = "cascade"


class Refused(ValueError):
    """Rows refer to a key that was to go or to change."""


def ordered(references: Iterable[Reference]) -> list[str]:
    """Tables so that every parent comes before its children; an error if they go round in a circle."""
    left = {(r.parent, r.child) for r in references}
    names = sorted({n for pair in left for n in pair})
    out: list[str] = []
    while names:
        free = [n for n in names if not any(child == n for _, child in left)]
        if not free:
            raise ValueError(f"tables refer to each other in a circle: {names}")
        out += free
        names = [n for n in names if n not in free]
        left = {(p, c) for p, c in left if p not in free}
    return out


def delete(tables: dict[str, DataFrame], references: list[Reference], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the rows of ``name`` that have a row in ``gone`` (by its columns, equal nulls too) are deleted.

    Children are followed through all levels, parents first, each table marked once; a child that goes by one
    reference isn't kept by another. A restricting reference is an error only if its child would stay.
    """
    out, lost = dict(tables), {}
    for table in dict.fromkeys([name, *ordered(references)]):
        if table not in tables:
            continue
        rows, marks = tables[table], []
        names = rows.columns
        if table == name:
            keys = gone.columns
            mark = gone.distinct().select(*(F.col(k).alias(f"_gone_{k}") for k in keys), F.lit(True).alias("_gone"))
            rows = rows.join(mark, [rows[k].eqNullSafe(mark[f"_gone_{k}"]) for k in keys], "left")
            marks.append(F.col("_gone").isNotNull())
        hit = {}
        for i, r in enumerate(references):
            if r.child == table and r.parent in lost:
                keys = lost[r.parent].select(F.col(r.key).alias(f"_key_{i}")).distinct().withColumn(f"_hit_{i}", F.lit(True))
                rows = rows.join(keys, F.col(r.column) == F.col(f"_key_{i}"), "left")
                hit[i] = F.col(f"_hit_{i}").isNotNull()
                if r.action == "cascade":
                    marks.append(hit[i])
        if not marks and not hit:
            continue
        goes = reduce(lambda a, b: a | b, marks) if marks else F.lit(False)
        refused = [hit[i] for i, r in enumerate(references) if i in hit and r.action == "restrict"]
        if refused and not rows.where(~goes & reduce(lambda a, b: a | b, refused)).isEmpty():
            raise Refused(f"rows of {table} refer to rows that were to be deleted")
        nulls = {r.column: hit[i] for i, r in enumerate(references) if i in hit and r.action == "null"}
        out[table] = rows.where(~goes).select(*(F.when(~nulls[c], F.col(c)).alias(c) if c in nulls else F.col(c) for c in names))
        if marks:
            lost[table] = rows.where(goes).select(*names)
    return out


def blocked(tables: dict[str, DataFrame], references: list[Reference], name: str, old: DataFrame) -> DataFrame:
    """(key, child, column, n): how many rows refer to each of the keys ``old`` (one column)."""
    key = old.columns[0]
    found = [
        tables[r.child].join(old, F.col(r.column) == old[key], "left_semi").groupBy(F.col(r.column).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), "n")
        for r in references
        if r.parent == name
    ]
    return reduce(DataFrame.union, found)


def rename(tables: dict[str, DataFrame], references: list[Reference], name: str, key: str, names: DataFrame) -> DataFrame:
    """The table with keys renamed by ``names`` (old, new); refused if a row anywhere refers to an old one, an error if a new one is taken."""
    if any(r.parent == name for r in references):
        first = blocked(tables, references, name, names.select("old")).orderBy("key", "child").first()
        if first is not None:
            raise Refused(f"{first['n']} rows of {first['child']} refer to {first['key']}")
    base = tables[name]
    renamed = base.join(names, base[key] == names["old"], "left")
    return unique(renamed.select(*(F.coalesce("new", base[key]).alias(c) if c == key else base[c] for c in base.columns)), [key])
