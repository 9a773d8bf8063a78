"""Joins by order: the last row as of a time, points in intervals, intervals that overlap.

None of them compares rows by key alone. ``asof`` sorts both sides together;
``overlapping`` compares rows that share a bin of their size, so the rows
compared follow the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a level are this many times as wide as those of the level below.
GROWTH = 8


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, columns: list[str], tolerance: Column | None = None, block: Callable[[Column], Column] | None = None, strict: bool = False, tie: list[str] = ()) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the last row of ``right`` that has its keys and isn't later.

    ``on`` is the time of both sides; a row at the same time counts unless
    ``strict``.  Of rows of one key and time the one with the greatest ``tie`` (then
    ``columns``) counts.  Matches older than ``tolerance`` are none.  Left rows without
    a match, key or time have nulls; right rows without key or time are ignored.

    One exchange of both sides: they are sorted together and the last right row is
    carried on.  ``block``, a function of time that never falls, cuts hot keys: then
    rows are dealt by key and block, and every block begins with a row that holds the
    last one of earlier blocks, found by an aggregation with one row for each key and block.
    """
    cut = block if block is not None else lambda t: F.lit(0)
    order = [*tie, *columns]
    found = F.struct(F.col(on).alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(order)))
    k = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    known = F.col(on).isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    r = right.where(known).select(*k, F.col(on).alias("t"), cut(F.col(on)).alias("b"), found.alias("found"))
    rows = left.select(*k, F.col(on).alias("t"), cut(F.col(on)).alias("b"), F.struct(*left.columns).alias("row"))
    none = F.lit(None).cast(r.schema["found"].dataType)
    # Order within a time: right rows before left ones, or after them if strict.
    both = r.select("*", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(2 if strict else 0).alias("turn"))
    both = both.unionByName(rows.select(*names, "t", "b", none.alias("found"), "row", F.lit(1).alias("turn")))
    if block is not None:
        ends = r.select(*names, "b", "found").unionByName(rows.select(*names, "b", none.alias("found"))).groupBy(*names, "b").agg(F.max("found").alias("found"))
        earlier = Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*names, "b", F.last("found", ignorenulls=True).over(earlier).alias("found")).where("found IS NOT NULL")
        both = both.unionByName(carried.select(*names, F.lit(None).cast(r.schema["t"].dataType).alias("t"), "b", "found", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(-1).alias("turn")))
    w = Window.partitionBy(*names, "b").orderBy(F.col("t").asc_nulls_first(), "turn", "found").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(F.col("t").isNotNull(), F.last("found", ignorenulls=True).over(w))
    matched = both.withColumn("last", last).where("row IS NOT NULL")
    if tolerance is not None:
        matched = matched.withColumn("last", F.when(F.col("last.t") >= F.col("t") - tolerance, F.col("last")))
    first = len(tie)
    return matched.select(*(F.col("row").getField(c).alias(c) for c in left.columns), *(F.col("last").getField(f"c{first + i}").alias(c) for i, c in enumerate(columns)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float, slack: float = 0.0) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals ``a`` of the left and ``b`` of the right have a point in common.

    A point is an interval whose ends are one column.  Ends may lie ``slack`` apart.
    Rows with a null end or key, or whose ends are the wrong way round, are in no pair.

    Every interval has a level, on which it covers two bins at most (bins are ``width``
    wide on level 0 and ``GROWTH`` times as wide on each next one), and is put
    into its bins of that level and of those above up to the widest interval's.
    Pairs meet on the higher of their levels, in the first bin that both cover, so
    each is made once, and short intervals aren't compared because a long one covers both.
    """
    widest = []
    for df, (lo, hi) in ((left, a), (right, b)):
        widest.append(df.agg(F.max(F.col(hi).cast("double") - F.col(lo).cast("double")).alias("w")).first()["w"] or 0.0)  # one number each
    top, w = 0, width
    while w < max(widest) + 2 * slack:
        top, w = top + 1, w * GROWTH
    sides = []
    for df, (lo, hi), name in ((left, a, "l"), (right, b, "r")):
        low, high = F.col(lo).cast("double") - (slack if name == "l" else 0.0), F.col(hi).cast("double") + (slack if name == "l" else 0.0)
        length = high - low
        level = F.lit(0)
        for n in range(1, top + 1):
            level = F.when(length > width * float(GROWTH) ** (n - 1), n).otherwise(level)
        side = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), F.struct(*df.columns).alias(name), low.alias(f"{name}_lo"), high.alias(f"{name}_hi"), level.alias(f"{name}_level"))
        side = side.where(F.col(f"{name}_lo") <= F.col(f"{name}_hi"))
        bins = F.flatten(
            F.transform(
                F.sequence(F.col(f"{name}_level"), F.lit(top)),
                lambda n: F.transform(
                    F.sequence(F.floor(F.col(f"{name}_lo") / (F.lit(width) * F.pow(F.lit(float(GROWTH)), n))), F.floor(F.col(f"{name}_hi") / (F.lit(width) * F.pow(F.lit(float(GROWTH)), n)))),
                    lambda x: F.struct(n.cast("int").alias("level"), x.cast("long").alias("bin")),
                ),
            )
        )
        sides.append(side.withColumn("at", F.explode(bins)).select("*", F.col("at.level").alias("level"), F.col("at.bin").alias("bin")).drop("at"))
    on = [*(f"k{i}" for i in range(len(keys))), "level", "bin"]
    size = F.lit(width) * F.pow(F.lit(float(GROWTH)), F.col("level"))
    met = sides[0].join(sides[1], on).where(
        (F.col("level") == F.greatest("l_level", "r_level"))
        & (F.col("bin") == F.floor(F.greatest("l_lo", "r_lo") / size))
        & (F.col("l_lo") <= F.col("r_hi"))
        & (F.col("r_lo") <= F.col("l_hi"))
    )
    rest = [c for c in right.columns if c not in keys]
    return met.select(*(F.col("l").getField(c).alias(c) for c in left.columns), *(F.col("r").getField(c).alias(c) for c in rest))
