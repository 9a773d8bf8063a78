"""Queries over series: valid bars, filling, joins by date, look-through discounts, zones and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.operators import series as S
from larkspur.plans.registry import query, relation
from larkspur.sources import bars, table

#: Bars as they come: with prices and volumes missing, and a volume that isn't a number.
RAW = """SELECT ticker, d, CASE WHEN day(d) % 9 = 0 THEN NULL ELSE open_c END AS open_c, high_c, CASE WHEN day(d) % 11 = 0 THEN NULL ELSE low_c END AS low_c, CASE WHEN day(d) % 13 = 0 THEN NULL ELSE close_c END AS close_c,
  CASE WHEN day(d) % 7 = 0 THEN NULL WHEN day(d) % 8 = 0 THEN 'n/a' ELSE CAST(volume AS STRING) END AS volume FROM {bars}"""


@query(
    """SELECT ticker, d, (open_c / 100.0::DOUBLE)::DECIMAL(18,4) AS open, (high_c / 100.0::DOUBLE)::DECIMAL(18,4) AS high, (low_c / 100.0::DOUBLE)::DECIMAL(18,4) AS low, (close_c / 100.0::DOUBLE)::DECIMAL(18,4) AS close, coalesce(try_cast(volume AS BIGINT), 0) AS volume
FROM raw WHERE open_c IS NOT NULL AND low_c IS NOT NULL AND close_c IS NOT NULL AND high_c IS NOT NULL AND d >= DATE '1998-12-01' - 400 ORDER BY ticker, d""",
    raw=RAW,
)
def valid_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The last 400 days before a day, in order, without bars that lack a price."""
    raw = relation(spark, sf, RAW, bars=bars(spark, sf)).where(F.col("d") >= F.date_sub(F.lit("1998-12-01").cast("date"), 400))
    return S.valid(raw).orderBy("ticker", "d")


@query("SELECT d, ticker, close_c AS close, volume FROM bars WHERE ticker IN ('Brand#11', 'Brand#12', 'Brand#13') AND close_c % 5 <> 0")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table, one column for each field and ticker, made long again; cells without a close go."""
    names = ["Brand#11", "Brand#12", "Brand#13"]
    b = bars(spark, sf).where(F.col("ticker").isin(names)).withColumn("close", F.when(F.col("close_c") % 5 != 0, F.col("close_c")))
    wide = b.groupBy("d").agg(*(F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{c}_{t}") for c in ("close", "volume") for t in names))
    return S.long_form(wide, "d", ["close", "volume"], names).select("d", "ticker", "close", "volume")


@query("""SELECT ticker, d, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled
FROM (SELECT ticker, d, CASE WHEN close_c % 4 = 0 THEN close_c END AS x FROM bars)""")
def bfill_ffill(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("x", F.when(F.col("close_c") % 4 == 0, F.col("close_c")))
    return b.select("ticker", "d", S.filled("x", "ticker", "d").alias("filled"))


@query("SELECT a.d, (a.close_c * 1.0::DOUBLE / b.close_c)::DECIMAL(18,4) AS ratio FROM bars a JOIN bars b ON a.d = b.d WHERE a.ticker = 'Brand#11' AND b.ticker = 'Brand#12'")
def ratio_series_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.side_by_side(bars(spark, sf), {"x": "Brand#11", "y": "Brand#12"}).select("d", X.dec(F.col("x") * F.lit(1.0) / F.col("y")).alias("ratio"))


@query("""SELECT d, nav::DECIMAL(18,4) AS nav, discount::DECIMAL(18,4) AS discount, CASE WHEN count(*) OVER w = 60 THEN (avg(discount) OVER w)::DECIMAL(18,4) END AS mean, CASE WHEN count(*) OVER w = 60 THEN ((discount - avg(discount) OVER w) / nullif(stddev_samp(discount) OVER w, 0))::DECIMAL(18,4) END AS score
FROM (SELECT d, nav, 1.0::DOUBLE - h / nav AS discount FROM (SELECT a.d, a.close_c::DOUBLE * (9200000000.0::DOUBLE / 1.0::DOUBLE * (0.228::DOUBLE * 0.434::DOUBLE) / 628849928.0::DOUBLE * 0.25::DOUBLE) AS nav, b.close_c::DOUBLE AS h FROM bars a JOIN bars b ON a.d = b.d WHERE a.ticker = 'Brand#11' AND b.ticker = 'Brand#12'))
WINDOW w AS (ORDER BY d ROWS 59 PRECEDING)""")
def nav_discount(spark: SparkSession, sf: str) -> DataFrame:
    """What a holding's receipt is worth by its asset, the discount, and how unusual that is."""
    pairs = S.side_by_side(bars(spark, sf), {"asset": "Brand#11", "holding": "Brand#12"}).withColumn("pair", F.lit("11-12"))
    found = S.discounts(pairs, "pair", "d", "asset", "holding", 60)
    return found.select("d", *(X.dec(F.col(c)).alias(c) for c in ("nav", "discount", "mean", "score")))


#: Every ticker as an asset, and the next one as its holding; the window runs over one row for each ticker.
PAIRS = "SELECT asset, holding FROM (SELECT p_brand AS asset, lead(p_brand) OVER (ORDER BY p_brand) AS holding FROM (SELECT DISTINCT p_brand FROM {part}) b) p WHERE holding IS NOT NULL"


@query("""SELECT asset, holding, d, nav::DECIMAL(18,4) AS nav, discount::DECIMAL(18,4) AS discount, CASE WHEN count(*) OVER w = 60 THEN (avg(discount) OVER w)::DECIMAL(18,4) END AS mean, CASE WHEN count(*) OVER w = 60 THEN ((discount - avg(discount) OVER w) / nullif(stddev_samp(discount) OVER w, 0))::DECIMAL(18,4) END AS score
FROM (SELECT *, 1.0::DOUBLE - h / nav AS discount FROM (SELECT p.asset, p.holding, a.d, a.close_c::DOUBLE * (9200000000.0::DOUBLE / 1.0::DOUBLE * (0.228::DOUBLE * 0.434::DOUBLE) / 628849928.0::DOUBLE * 0.25::DOUBLE) AS nav, b.close_c::DOUBLE AS h FROM pairs p JOIN bars a ON a.ticker = p.asset JOIN bars b ON b.ticker = p.holding AND a.d = b.d))
WINDOW w AS (PARTITION BY asset, holding ORDER BY d ROWS 59 PRECEDING)""", pairs=PAIRS)
def pair_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """Discounts of all pairs of a table, each pair's window apart from the others."""
    found = S.discounts(S.paired(bars(spark, sf), relation(spark, sf, PAIRS)), ["asset", "holding"], "d", "asset_value", "holding_value", 60)
    return found.select("asset", "holding", "d", *(X.dec(F.col(c)).alias(c) for c in ("nav", "discount", "mean", "score")))


@query("SELECT ticker, n - k AS idx, close_c FROM (SELECT ticker, d, close_c, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k, least(100, count(*) OVER (PARTITION BY ticker)) AS n FROM bars) WHERE k <= 100")
def tail_reindexed(spark: SparkSession, sf: str) -> DataFrame:
    """The last hundred bars, numbered from 0 by date."""
    down = Window.partitionBy("ticker").orderBy(F.desc("d"))
    last = bars(spark, sf).withColumn("k", F.row_number().over(down)).where("k <= 100")
    return last.select("ticker", (F.row_number().over(Window.partitionBy("ticker").orderBy("d")) - 1).alias("idx"), "close_c")


#: Price bands around the middle of each ticker's range.
BANDS = "SELECT ticker, CASE WHEN side = 0 THEN 'support' ELSE 'resistance' END AS kind, CAST(lo + (hi - lo) * (2 + 3 * side) / 10 AS DOUBLE) AS low, CAST(lo + (hi - lo) * (3 + 3 * side) / 10 AS DOUBLE) AS high FROM (SELECT ticker, min(low_c) AS lo, max(high_c) AS hi FROM {bars} GROUP BY ticker) r, (VALUES (0), (1)) s(side)"


@query(
    """SELECT z.ticker, z.kind, count(*) FILTER (b.low_c <= z.high AND b.high_c >= z.low) AS tests, count(*) FILTER (b.low_c <= z.high AND b.high_c >= z.low AND CASE WHEN z.kind = 'support' THEN b.close_c > z.high ELSE b.close_c < z.low END) AS rejections
FROM bands z JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM bars) b ON z.ticker = b.ticker AND k <= 120 GROUP BY z.ticker, z.kind""",
    bands=BANDS,
)
def zone_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    return S.overlaps(relation(spark, sf, BANDS, bars=b), b, 120).select("ticker", "kind", "tests", "rejections")


@query("SELECT o_custkey AS key, string_agg(o_orderkey || ':' || floor(o_totalprice)::BIGINT, ',' ORDER BY o_orderkey) AS pairs FROM orders GROUP BY o_custkey")
def zip_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of the same length side by side: numbers and prices of each key."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("p")).alias("x"))
    lists = o.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x")).select("key", F.col("x.id").alias("ids"), F.col("x.p").alias("prices"))
    return lists.select("key", F.array_join(F.transform(F.arrays_zip("ids", "prices"), lambda z: F.concat_ws(":", z["ids"].cast("string"), z["prices"].cast("string"))), ",").alias("pairs"))
