"""Queries that join by order: rows as of a time, points in zones, intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import operators as O
from larkspur.operators import joins
from larkspur.plans.registry import query, relation
from larkspur.sources import bars, table


@query("""SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL (
  SELECT event_id, value FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 12 HOUR ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true""")
def asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last view up to then, none if it is older than half a day; hot users are cut by day."""
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id", "view_value"], F.expr("INTERVAL 12 HOURS"), lambda t: F.to_date(t))
    return found.select("event_id", "view_id", "view_value")


@query("""SELECT i.ticker, i.d, m.a::DECIMAL(18,4) AS sma50 FROM (SELECT ticker, unnest(generate_series(min(d), max(d) + 40, INTERVAL 7 DAY))::DATE AS d FROM bars GROUP BY ticker) i
ASOF LEFT JOIN (SELECT ticker, d, sum(close_c) OVER w / count(*) OVER w AS a FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING)) m ON i.ticker = m.ticker AND i.d >= m.d""")
def sma_on_display_index(spark: SparkSession, sf: str) -> DataFrame:
    """The daily average padded to the days that a chart shows, those after the last bar too."""
    b = bars(spark, sf)
    shown = b.groupBy("ticker").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select("ticker", F.explode(F.sequence("lo", F.date_add("hi", 40), F.expr("INTERVAL 7 DAYS"))).alias("d"))
    daily = b.select("ticker", "d", F.avg("close_c").over(O.rolling("ticker", "d", 50)).alias("a"))
    return joins.asof(shown, daily, ["ticker"], "d", ["a"], block=F.year).select("ticker", "d", X.dec(F.col("a")).alias("sma50"))


@query(
    """SELECT a.ticker, a.d, b.close_c AS other_c, date_diff('day', b.d, a.d) AS age FROM (SELECT ticker, d, CASE ticker WHEN 'Brand#11' THEN 'Brand#12' WHEN 'Brand#12' THEN 'Brand#55' END AS other FROM bars) a
LEFT JOIN LATERAL (SELECT d, close_c FROM bars b WHERE b.ticker = a.other AND b.d < a.d AND b.d >= a.d - 3 ORDER BY b.d DESC LIMIT 1) b ON true WHERE a.ticker IN ('Brand#11', 'Brand#12', 'Brand#13')"""
)
def asof_other_ticker(spark: SparkSession, sf: str) -> DataFrame:
    """The close of another ticker before each day, at most three days old; tickers without another one have none."""
    b = bars(spark, sf)
    other = F.when(F.col("ticker") == "Brand#11", "Brand#12").when(F.col("ticker") == "Brand#12", "Brand#55")
    days = b.where("ticker IN ('Brand#11', 'Brand#12', 'Brand#13')").select("ticker", "d", other.alias("other"))
    closes = b.select(F.col("ticker").alias("other"), "d", F.col("close_c").alias("other_c"), F.col("d").alias("on"))
    found = joins.asof(days, closes, ["other"], "d", ["other_c", "on"], F.expr("INTERVAL 3 DAYS"), F.year, strict=True)
    return found.select("ticker", "d", "other_c", F.datediff("d", "on").cast("long").alias("age"))


#: Ten bands of each ticker's range; every third one is narrow, one covers half of it.
ZONES = """SELECT ticker, CAST(k AS INT) AS zone, CAST(lo + (hi - lo) * k / 10 AS DOUBLE) AS low, CAST(CASE WHEN k = 3 THEN lo + (hi - lo) * 8 / 10 WHEN k % 3 = 0 THEN lo + (hi - lo) * k / 10 + 50 ELSE lo + (hi - lo) * (k + 1) / 10 END AS DOUBLE) AS high
  FROM (SELECT ticker, min(low_c) AS lo, max(high_c) AS hi FROM {bars} GROUP BY ticker) r, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) s(k)"""


@query(
    """SELECT z.ticker, z.zone, count(p.x) AS points, max(p.d) AS last_d FROM zones z LEFT JOIN (
  SELECT ticker, d, high_c::DOUBLE AS x FROM (SELECT *, lag(high_c) OVER w AS a, lead(high_c) OVER w AS b FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE high_c > a AND high_c > b) p
ON p.ticker = z.ticker AND p.x >= z.low - 1e-12::DOUBLE AND p.x <= z.high + 1e-12::DOUBLE GROUP BY z.ticker, z.zone""",
    zones=ZONES,
)
def swing_points_in_zones(spark: SparkSession, sf: str) -> DataFrame:
    """How many swing highs lie in each zone, and the last of them."""
    b = bars(spark, sf)
    w = Window.partitionBy("ticker").orderBy("d")
    high = F.col("high_c")
    swings = b.withColumns({"a": F.lag("high_c").over(w), "b": F.lead("high_c").over(w)}).where((high > F.col("a")) & (high > F.col("b"))).select("ticker", "d", high.cast("double").alias("x"))
    z = relation(spark, sf, ZONES, bars=b)
    met = joins.overlapping(z, swings, ["ticker"], ("low", "high"), ("x", "x"), 1000.0, 1e-12).groupBy("ticker", "zone").agg(F.count("x").alias("points"), F.max("d").alias("last_d"))
    return z.select("ticker", "zone").join(met, ["ticker", "zone"], "left").select("ticker", "zone", F.coalesce("points", F.lit(0)).alias("points"), "last_d")


@query(
    "SELECT z.ticker, z.zone, count(*) AS bars, count(*) FILTER (b.close_c < z.low) AS below, min(b.d) AS first_d FROM zones z JOIN bars b ON b.ticker = z.ticker AND b.low_c <= z.high AND b.high_c >= z.low GROUP BY z.ticker, z.zone",
    zones=ZONES,
)
def bars_over_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The bars whose range has a point of a zone, over all of each ticker's history."""
    b = bars(spark, sf)
    met = joins.overlapping(relation(spark, sf, ZONES, bars=b), b.select("ticker", "d", "low_c", "high_c", "close_c"), ["ticker"], ("low", "high"), ("low_c", "high_c"), 1000.0)
    return met.groupBy("ticker", "zone").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("close_c") < F.col("low")).alias("below"), F.min("d").alias("first_d"))


@query("""SELECT * FROM (WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + value * 60 AS b FROM events)
SELECT x.event_id, y.event_id AS other_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a <= y.b AND y.a <= x.b)""")
def overlapping_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a user's events whose spans, as many minutes as the event's value, overlap."""
    s = table(spark, sf, "events").select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a")).withColumn("b", F.col("a") + F.col("value") * 60)
    other = s.select("user_id", F.col("event_id").alias("other_id"), F.col("a").alias("c"), F.col("b").alias("e"))
    return joins.overlapping(s, other, ["user_id"], ("a", "b"), ("c", "e"), 600.0).where("event_id < other_id").select("event_id", "other_id")
