"""Roll-ups from stored partial states: days are summed up once, weeks, months and averages are read from them.

A state (first, last, high, low, n, total, volume) of a key and a day can be merged with
another one of the same day, whichever trades came first, and with those of other days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("first", "last", "high", "low", "n", "total", "volume")


def states(trades: DataFrame, key: str, day: str, order: str, price: str, volume: str) -> DataFrame:
    """(key, day, state columns) of single trades; first and last hold the trade's day, its place in the order and its price."""
    at = F.struct(F.col(day).alias("day"), F.col(order).alias("at"), F.col(price).alias("price"))
    return trades.groupBy(key, day).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.max(price).alias("high"), F.min(price).alias("low"), F.count(price).alias("n"), F.sum(price).alias("total"), F.sum(volume).alias("volume")
    )


def merged(states: DataFrame, *keys: str | Column) -> DataFrame:
    """One state for each group of ``keys``."""
    return states.groupBy(*keys).agg(*({"first": F.min, "low": F.min, "last": F.max, "high": F.max}.get(c, F.sum)(c).alias(c) for c in STATE))


def finished(states: DataFrame, key: str, bucket: Column) -> DataFrame:
    """(key, bucket, open, high, low, close, volume, n, mean): the buckets of a key."""
    rows = merged(states, key, bucket.alias("bucket"))
    return rows.select(key, "bucket", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume", "n", F.try_divide(F.col("total"), F.col("n")).alias("mean"))


def average(states: DataFrame) -> DataFrame:
    """(n, mean) over all states: the mean of means weighted by their numbers."""
    return states.agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
