"""Relational and time-series operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns: one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(key, *(F.col("_r").getField(c).alias(c) for c in rest)).select(*df.columns)


def nth_latest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") == n).drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Duplicates by ``keys`` go; the row with the smallest ``order`` stays."""
    rest = [c for c in df.columns if c not in keys]
    low = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return low.select(*keys, *(F.col("_r").getField(c).alias(c) for c in rest)).select(*df.columns)


def ordered_array(column: str, order: list[str]) -> Column:
    """An aggregate: the column's values as an array, the greatest ``order`` first, nulls in their places; null for a group without rows."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.struct(F.col(column).alias("v")).alias("v"))), asc=False)
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda r: r["v"]["v"]))


def or_join(left: DataFrame, right: DataFrame, left_id: str, candidates: Column, right_key: str, right_id: str) -> DataFrame:
    """Left join on any of several keys of the left row, as an equi-join of exploded candidates."""
    pairs = left.select(left_id, F.explode(F.array_distinct(candidates)).alias("_k")).join(right, F.col("_k") == F.col(right_key)).drop("_k").dropDuplicates([left_id, right_id])
    return left.join(pairs, left_id, "left")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``base`` with the delta's rows: of rows with equal keys only the ``update`` columns are taken, others are added."""
    new = delta.select(*keys, F.struct(*(c for c in base.columns if c not in keys)).alias("_new"))
    both = base.withColumn("_old", F.lit(True)).join(new, keys, "full")
    value = lambda c: F.coalesce(F.col("_new").getField(c), F.col(c)) if c in update else F.when(F.col("_old"), F.col(c)).otherwise(F.col("_new").getField(c))
    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in base.columns))


def upsert_sides(rows: DataFrame, keys: list[str], update: list[str], side: str) -> DataFrame:
    """``upsert`` of base rows (``side`` 0) and delta rows (1) in one frame, one of each for a key: an aggregation, without a join."""
    take = lambda c: F.max_by(c, side) if c in update else F.min_by(c, side)
    return rows.groupBy(*keys).agg(*(take(c).alias(c) for c in rows.columns if c not in (*keys, side)))


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))


def resample(bars: DataFrame, key: str, date: str, bucket: Column) -> DataFrame:
    """Open, high, low, close and volume of each bucket; empty buckets aren't there."""
    return bars.groupBy(key, bucket.alias("bucket")).agg(
        F.min_by("open_c", date).alias("open_c"), F.max("high_c").alias("high_c"), F.min("low_c").alias("low_c"), F.max_by("close_c", date).alias("close_c"), F.sum("volume").alias("volume")
    )


def week_end(date: str) -> Column:
    """The Sunday on or after a date."""
    return F.date_add(F.col(date), 6 - F.weekday(F.col(date)))


def rolling(key: str, date: str, n: int):
    return Window.partitionBy(key).orderBy(date).rowsBetween(1 - n, 0)


def full(value: Column, of: str, window, n: int) -> Column:
    """A rolling value, null until the window is full."""
    return F.when(F.count(of).over(window) == n, value)


def true_range(key: str, date: str) -> Column:
    before = F.lag("close_c").over(Window.partitionBy(key).orderBy(date))
    return F.greatest(F.col("high_c") - F.col("low_c"), F.abs(F.col("high_c") - before), F.abs(F.col("low_c") - before))
