"""Series by date: valid bars, filling, merging, look-through values, rolling discounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.joins import overlapping

PRICES = ("open", "high", "low", "close")


def valid(bars: DataFrame) -> DataFrame:
    """Raw bars in cents as numbers of the currency; without rows that lack a price, a missing volume is 0."""
    cast = bars.select("ticker", "d", *((F.col(f"{c}_c").try_cast("decimal(18,2)") / 100).cast("decimal(18,4)").alias(c) for c in PRICES), F.coalesce(F.col("volume").try_cast("long"), F.lit(0)).alias("volume"))
    return cast.na.drop(subset=list(PRICES))


def long_form(wide: DataFrame, key: str, fields: list[str], tickers: list[str]) -> DataFrame:
    """Columns ``<field>_<ticker>`` as one row for each ticker; tickers without a close are left out."""
    each = F.array(*(F.struct(F.lit(t).alias("ticker"), *(F.col(f"`{f}_{t}`").alias(f) for f in fields)) for t in tickers))
    return wide.select(key, F.inline(each)).where(F.col("close").isNotNull())


def filled(x: str, key: str, order: str) -> Column:
    """A value, else the next one, else the last one."""
    w = Window.partitionBy(key).orderBy(order)
    after = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(after, before)


def aligned(left: DataFrame, right: DataFrame, on: str, drop: list[str]) -> DataFrame:
    """Two series on the dates that both have, without nulls."""
    return left.join(right, on).na.drop(subset=drop)


def side_by_side(bars: DataFrame, names: dict[str, str], value: str = "close_c") -> DataFrame:
    """(d, one column for each name with the value of its ticker) on the days that all of them have: one scan, one aggregation."""
    ticker = F.col("ticker")
    days = bars.where(ticker.isin(*names.values())).groupBy("d").agg(*(F.max(F.when(ticker == t, F.col(value))).alias(c) for c, t in names.items()))
    return days.na.drop(subset=list(names))


def paired(bars: DataFrame, pairs: DataFrame, value: str = "close_c") -> DataFrame:
    """(asset, holding, d, asset_value, holding_value) of every pair (asset, holding) on the days that both have: one scan, one join by ticker, one aggregation.

    A ticker may be in any number of pairs, on either side; repeated pairs count once, pairs with a null have no days.
    """
    sides = F.array(F.struct(F.lit(True).alias("first"), F.col("asset").alias("ticker")), F.struct(F.lit(False).alias("first"), F.col("holding").alias("ticker")))
    roles = pairs.select("asset", "holding").distinct().select("asset", "holding", F.inline(sides))
    rows = bars.select("ticker", "d", F.col(value).alias("v")).join(roles, "ticker")
    days = rows.groupBy("asset", "holding", "d").agg(F.max(F.when(F.col("first"), F.col("v"))).alias("asset_value"), F.max(F.when(~F.col("first"), F.col("v"))).alias("holding_value"))
    return days.na.drop(subset=["asset_value", "holding_value"])


@dataclass(frozen=True)
class LookThrough:
    """Stakes, share counts and ratios of the chain from the asset to the holding's receipt."""

    stake: float = 0.228
    holding_stake: float = 0.434
    holding_shares: int = 628_849_928
    receipt_ratio: float = 0.25
    asset_shares: int = 9_200_000_000
    asset_ratio: float = 1.0


def nav(asset: Column, c: LookThrough = LookThrough()) -> Column:
    """What the asset's price makes one receipt of the holding worth."""
    per_receipt = c.asset_shares / c.asset_ratio * (c.stake * c.holding_stake) / c.holding_shares * c.receipt_ratio
    return asset.cast("double") * F.lit(per_receipt)


def discounts(pairs: DataFrame, key: str | list[str], date: str, asset: str, holding: str, n: int = 252, chain: LookThrough = LookThrough()) -> DataFrame:
    """Adds nav, discount, its rolling mean and sample deviation over full windows, and its score; a deviation of 0 gives null."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(1 - n, 0)
    d = pairs.withColumn("nav", nav(F.col(asset), chain)).withColumn("discount", F.lit(1.0) - F.try_divide(F.col(holding).cast("double"), F.col("nav")))
    whole = F.count("discount").over(w) == n
    d = d.withColumns({"mean": F.when(whole, F.avg("discount").over(w)), "deviation": F.when(whole, F.stddev_samp("discount").over(w))})
    return d.withColumn("score", F.try_divide(F.col("discount") - F.col("mean"), F.col("deviation")))


def overlaps(zones: DataFrame, bars: DataFrame, last: int, width: float = 1000.0) -> DataFrame:
    """Adds to every zone (ticker, kind, low, high) how many of the ticker's last bars touch it, and how many of these close beyond it."""
    w = Window.partitionBy("ticker").orderBy(F.desc("d"))
    recent = bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).select("ticker", "low_c", "high_c", "close_c")
    keys = ["ticker", "kind", "low", "high"]
    touching = overlapping(zones.select(*keys), recent, ["ticker"], ("low", "high"), ("low_c", "high_c"), width)
    beyond = F.when(F.col("kind") == "support", F.col("close_c") > F.col("high")).otherwise(F.col("close_c") < F.col("low"))
    counts = touching.groupBy(*keys).agg(F.count(F.lit(1)).alias("tests"), F.count_if(beyond).alias("rejections"))
    return zones.select(*keys).join(counts, keys, "left").na.fill(0, ["tests", "rejections"])
