"""Domain tables over the star schema: daily bars, fundamentals, positions, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over four tasks for each core, by a hash of the key: for small rows of which each makes much work.

    A file of a million such rows is a few megabytes, which Spark reads in one task.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, d, c, q, and their order in one number): single trades, the parts' table joined as Spark chooses."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("d"), F.floor("l_extendedprice").cast("long").alias("c"), F.col("l_quantity").cast("long").alias("q"), _place().alias("place"))
    return line.join(part, "l_partkey")


def _place():
    """The order of a day's trades, with the price in its last digits: a number, so that its minimum and maximum
    are hash aggregates; order key, line number below 10 and price below 10^10 have digits of their own."""
    key = F.col("l_orderkey").cast("decimal(26,0)") * F.lit(100_000_000_000).cast("decimal(12,0)")
    return (key + F.col("l_linenumber").cast("decimal(2,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.floor("l_extendedprice").cast("decimal(11,0)")).cast("decimal(38,0)")


def _daily(trades: DataFrame) -> DataFrame:
    price = lambda x: (x % F.lit(10_000_000_000).cast("decimal(11,0)")).cast("long")
    days = trades.groupBy("ticker", "d").agg(F.min("place").alias("a"), F.max("c").alias("high_c"), F.min("c").alias("low_c"), F.max("place").alias("z"), F.sum("q").alias("volume"))
    return days.select("ticker", "d", price(F.col("a")).alias("open_c"), "high_c", "low_c", price(F.col("z")).alias("close_c"), "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each brand in cents: (ticker, d, open_c, high_c, low_c, close_c, volume)."""
    return _daily(trades(spark, sf_dir))


def recent_bars(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """``bars`` of the last calendar days of each ticker: older trades go before anything is shuffled by day."""
    t = trades(spark, sf_dir)
    last = t.groupBy("ticker").agg(F.max("d").alias("_last"))  # one row for each ticker
    return _daily(t.join(last, "ticker").where(F.col("d") >= F.date_sub("_last", days)))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated results of each key: (key, id, period_end, heps_c, earn_c, nav_c, dividend_c); earnings and asset values can be 0 or negative, dividends missing."""
    heps, id = F.floor("o_totalprice").cast("long"), F.col("o_orderkey")  # noqa: A001
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), id.alias("id"), F.col("o_orderdate").cast("date").alias("period_end"), heps.alias("heps_c"),
        F.when(id % 13 == 0, 0).when(id % 17 == 0, -heps).otherwise(heps).alias("earn_c"), (heps * 3 - id % 7 * 100_000).alias("nav_c"), F.when(id % 9 != 0, F.floor(heps / 20)).cast("long").alias("dividend_c"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in cents around a price: (key, name, status, price_c, entry_c, target_c, stop_c, is_long)."""
    c = table(spark, sf_dir, "customer").withColumn("price_c", F.floor(F.abs("c_acctbal") * 100).cast("long"))
    step, is_long = F.col("c_custkey") % 7, F.col("c_custkey") % 3 != 0
    sign = F.when(is_long, 1).otherwise(-1)
    return c.select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), "price_c",
        (F.col("price_c") - sign * (step - 3) * 1000).alias("entry_c"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("price_c") + sign * (step + 1) * 5000).alias("target_c"),
        (F.col("price_c") - sign * (step + 1) * 2000).alias("stop_c"), is_long.alias("is_long"),
    )


#: The same relations as DuckDB common table expressions.
SQL = """bars AS (
  SELECT ticker, d, first(c ORDER BY l_orderkey, l_linenumber, c) AS open_c, max(c) AS high_c, min(c) AS low_c, last(c ORDER BY l_orderkey, l_linenumber, c) AS close_c, sum(q)::BIGINT AS volume
  FROM (SELECT p_brand AS ticker, l_shipdate::DATE AS d, l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS c, l_quantity::BIGINT AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ticker, d),
fundamentals AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderdate::DATE AS period_end, heps_c, CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN -heps_c ELSE heps_c END AS earn_c, heps_c * 3 - o_orderkey % 7 * 100000 AS nav_c, CASE WHEN o_orderkey % 9 <> 0 THEN floor(heps_c / 20)::BIGINT END AS dividend_c
  FROM (SELECT *, floor(o_totalprice)::BIGINT AS heps_c FROM orders)),
watchlist AS (
  SELECT c_custkey AS key, c_name AS name, c_mktsegment AS status, price_c, price_c - s * (c_custkey % 7 - 3) * 1000 AS entry_c,
    CASE WHEN c_custkey % 11 <> 0 THEN price_c + s * (c_custkey % 7 + 1) * 5000 END AS target_c, price_c - s * (c_custkey % 7 + 1) * 2000 AS stop_c, s = 1 AS is_long
  FROM (SELECT *, floor(abs(c_acctbal) * 100)::BIGINT AS price_c, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE -1 END AS s FROM customer))"""
