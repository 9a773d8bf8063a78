"""Registry of the queries over the driver tables and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import operators as O
from larkspur.functions import text as T
from larkspur.plans.registry import AS_OF, ORACLES, QUERIES, query
from larkspur.sources import bars, fundamentals, recent_bars, table, watchlist

__all__ = ["AS_OF", "ORACLES", "QUERIES", "query"]


@query("""SELECT key, name, price_c, period_end, n_results, (price_c / nullif(e, 0))::DECIMAL(18,4) AS pe, (dividend_c / nullif(price_c, 0) * 100)::DECIMAL(18,4) AS yield_pct, growth::DECIMAL(18,4) AS cagr,
  CASE WHEN s > 0 AND e > s THEN (price_c / e / nullif(growth, 0))::DECIMAL(18,4) END AS peg, fair::DECIMAL(18,0) AS graham, ((price_c - fair) / fair * 100)::DECIMAL(18,4) AS premium_pct, years::DECIMAL(18,1) AS years
FROM (SELECT *, CASE WHEN s > 0 AND e > 0 AND years >= 1 THEN (pow(e / s, 1.0::DOUBLE / years) - 1) * 100 END AS growth, CASE WHEN e > 0 AND nav_c > 0 THEN sqrt(22.5::DOUBLE * e * nav_c) END AS fair
FROM (SELECT w.key, w.name, price_c, f.*, days / 365.25::DOUBLE AS years FROM watchlist w JOIN (
  SELECT key AS k, count(*) AS n_results, max(period_end) AS period_end, arg_min(earn_c, (period_end, id)) AS s, arg_max(earn_c, (period_end, id)) AS e, arg_max(nav_c, (period_end, id)) AS nav_c,
    max(CASE WHEN last THEN dividend_c END) AS dividend_c, max(period_end) - min(period_end) AS days
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY period_end DESC, id DESC) = 1 AS last FROM fundamentals) GROUP BY key) f ON w.key = f.k))""")
def valuation_view(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of the price to the first and last results of each key (one pass over the results)."""
    order = F.struct("period_end", "id")
    last = F.max_by(F.struct("earn_c", "nav_c", "dividend_c"), order)
    f = fundamentals(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n_results"), F.max("period_end").alias("period_end"), F.min("period_end").alias("first_end"), F.min_by("earn_c", order).alias("s"), last.alias("z"))
    f = f.select("*", "z.*", F.datediff("period_end", "first_end").alias("days"))
    price, s, e, days = F.col("price_c"), F.col("s"), F.col("earn_c"), F.col("days")
    fair = X.fair_value(e, F.col("nav_c"))
    return watchlist(spark, sf).join(f, "key").select(
        "key", "name", "price_c", "period_end", "n_results", X.dec(F.try_divide(price, e)).alias("pe"), X.dec(F.try_divide(F.col("dividend_c"), price) * 100).alias("yield_pct"), X.dec(X.cagr(s, e, days)).alias("cagr"),
        X.dec(X.peg(price, s, e, days)).alias("peg"), X.dec(fair, 0).alias("graham"), X.dec((price - fair) / fair * 100).alias("premium_pct"), X.dec(X.years(days), 1).alias("years"),
    )


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return O.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT key, id, (period_end + INTERVAL 1 YEAR)::DATE AS due FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY period_end DESC NULLS FIRST, id DESC) AS k FROM fundamentals) WHERE k = 2")
def second_latest_plus_year(spark: SparkSession, sf: str) -> DataFrame:
    found = O.nth_latest(fundamentals(spark, sf), "key", [F.desc_nulls_first("period_end"), F.desc("id")], 2)
    return found.select("key", "id", F.add_months("period_end", 12).alias("due"))


@query("""SELECT w.key, last_end, CASE WHEN n >= 2 THEN (last_end + INTERVAL 1 YEAR)::DATE WHEN n = 1 THEN last_end + 180 END AS due, n IS NULL AS no_data
FROM watchlist w LEFT JOIN (SELECT key, count(*) AS n, max(period_end) AS last_end FROM fundamentals GROUP BY key) f ON w.key = f.key
WHERE n IS NULL OR CASE WHEN n >= 2 THEN (last_end + INTERVAL 1 YEAR)::DATE ELSE last_end + 180 END <= DATE '2024-01-31'""")
def needs_update(spark: SparkSession, sf: str) -> DataFrame:
    f = fundamentals(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("period_end").alias("last_end"))
    due = F.when(F.col("n") >= 2, F.add_months("last_end", 12)).when(F.col("n") == 1, F.date_add("last_end", 180))
    rows = watchlist(spark, sf).select("key").join(f, "key", "left").withColumn("due", due)
    return rows.where(F.col("n").isNull() | (F.col("due") <= F.lit(AS_OF).cast("date"))).select("key", "last_end", "due", F.col("n").isNull().alias("no_data"))


@query("""SELECT w.key, CASE status WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS rank, coalesce(unread, 0)::BIGINT AS unread, h.user_id IS NOT NULL AS holding
FROM watchlist w LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'view') AS unread FROM events GROUP BY user_id) u ON w.key = u.user_id
LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') h ON w.key = h.user_id""")
def watchlist_base(spark: SparkSession, sf: str) -> DataFrame:
    """Priority rank, unread count and the holding flag of each entry: one aggregation of the feed."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count_if(F.col("event_type") == "view").alias("unread"), F.bool_or(F.col("event_type") == "purchase").alias("h"))
    rank = F.when(F.col("status") == "BUILDING", 1).when(F.col("status") == "MACHINERY", 2).otherwise(3)
    return watchlist(spark, sf).join(e, "key", "left").select("key", rank.alias("rank"), F.coalesce("unread", F.lit(0)).alias("unread"), F.coalesce("h", F.lit(False)).alias("holding"))


@query("SELECT key, status FROM watchlist w WHERE NOT EXISTS (SELECT 1 FROM fundamentals f WHERE f.key = w.key AND heps_c > 200000) AND trim(status) <> '' AND status NOT IN ('FURNITURE')")
def no_research_anti(spark: SparkSession, sf: str) -> DataFrame:
    w = watchlist(spark, sf).where((F.trim("status") != "") & ~F.col("status").isin("FURNITURE"))
    return w.join(fundamentals(spark, sf).where("heps_c > 200000"), "key", "left_anti").select("key", "status")


@query("SELECT p.p_partkey AS id, s.s_suppkey AS match_id FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey OR s.s_suppkey = p.p_size")
def or_join_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("match_id"))
    return O.or_join(p, s, "id", F.array("id", F.col("p_size").cast("long")), "match_id", "match_id").select("id", "match_id")


@query("SELECT w.key, array_to_string(list_transform(f.x, lambda v: coalesce(v::VARCHAR, 'none')), ',') AS dividends, len(f.x) AS n FROM watchlist w LEFT JOIN (SELECT key, array_agg(dividend_c ORDER BY period_end DESC, id DESC) AS x FROM fundamentals GROUP BY key) f ON w.key = f.key")
def ordered_array_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Dividends of each key, the newest first; missing ones have a place, and a key without results has no list."""
    f = fundamentals(spark, sf).groupBy("key").agg(O.ordered_array("dividend_c", ["period_end", "id"]).alias("x"))
    told = F.array_join(F.transform("x", lambda v: F.coalesce(v.cast("string"), F.lit("none"))), ",")
    return watchlist(spark, sf).select("key").join(f, "key", "left").select("key", told.alias("dividends"), F.size("x").cast("long").alias("n")).withColumn("n", F.when(F.col("dividends").isNotNull(), F.col("n")))


@query("SELECT event_type, count(*) AS n, (sum(floor(value * 100)::BIGINT) / count(*))::DECIMAL(18,4) AS mean_c FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type")
def avg_count_since(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), X.dec(F.sum(F.floor(F.col("value") * 100).cast("long")) / F.count(F.lit(1))).alias("mean_c"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'view' DESC, ts DESC, event_id) AS k FROM events) WHERE k <= 50")
def feed_topk(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy((F.col("event_type") == "view").desc(), F.desc("ts"), "event_id")
    return table(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k <= 50").select("user_id", "event_id")


@query("SELECT event_id, kind FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN upper(event_type) END AS kind FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) WHERE coalesce(lower(kind), '') <> 'click' AND value < 90")
def feed_global_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The newest hundred, then the filters; what has no kind stays."""
    newest = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_id") % 5 != 0, F.upper("event_type"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return newest.where((F.coalesce(F.lower("kind"), F.lit("")) != "click") & (F.col("value") < 90)).select("event_id", "kind")


_PNL = """SELECT l_orderkey, l_partkey, sum(q)::BIGINT AS qty, sum(q * c)::BIGINT AS cost_c, sum(q * coalesce(p, c))::BIGINT AS value_c, sum(q * p - q * c)::BIGINT AS pnl_c
FROM (SELECT l_orderkey, l_partkey, l_quantity::BIGINT AS q, floor(l_extendedprice / l_quantity * 100)::BIGINT AS c, floor(p_retailprice * 100)::BIGINT AS p FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON p_partkey = l_partkey WHERE l_linenumber <> 7) GROUP BY l_orderkey, l_partkey"""


@query(f"SELECT *, CASE WHEN cost_c = 0 THEN 0 ELSE pnl_c * 100.0::DOUBLE / cost_c END::DECIMAL(18,4) AS pct FROM ({_PNL})")
def portfolio_holdings_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """Cost, value, profit and its percentage of each holding; without a price it is worth its cost and has no profit."""
    return _holdings(spark, sf).withColumn("pct", X.dec(F.when(F.col("cost_c") == 0, 0.0).otherwise(F.col("pnl_c") * F.lit(100.0) / F.col("cost_c"))))


def _holdings(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("p"))
    held = table(spark, sf, "lineitem").where("l_linenumber <> 7").na.drop(subset=["l_quantity", "l_extendedprice"])
    rows = held.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("c")).join(p, "l_partkey", "left")
    return rows.groupBy("l_orderkey", "l_partkey").agg(F.sum("q").alias("qty"), F.sum(F.expr("q * c")).alias("cost_c"), F.sum(F.expr("q * coalesce(p, c)")).alias("value_c"), F.sum(F.expr("q * p - q * c")).alias("pnl_c"))


@query(f"SELECT o_custkey AS portfolio, sum(cost_c)::BIGINT AS cost_c, sum(value_c)::BIGINT AS value_c, sum(value_c - cost_c)::BIGINT AS pnl_c, CASE WHEN sum(cost_c) = 0 THEN 0 ELSE sum(value_c - cost_c)::BIGINT * 100.0::DOUBLE / sum(cost_c)::BIGINT END::DECIMAL(18,4) AS pct FROM ({_PNL}) JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey")
def portfolio_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("portfolio"))
    total = _holdings(spark, sf).join(o, "l_orderkey").groupBy("portfolio").agg(F.sum("cost_c").alias("cost_c"), F.sum("value_c").alias("value_c"), F.sum(F.col("value_c") - F.col("cost_c")).alias("pnl_c"))
    return total.withColumn("pct", X.dec(F.when(F.col("cost_c") == 0, 0.0).otherwise(F.col("pnl_c") * F.lit(100.0) / F.col("cost_c"))))


@query("SELECT c_custkey AS key, trunc(c_acctbal * 100)::BIGINT AS cents, trunc(c_acctbal)::BIGINT AS units FROM customer")
def truncated_cents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers toward zero, for negative amounts too."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), T.whole(F.col("c_acctbal") * 100).alias("cents"), T.whole(F.col("c_acctbal")).alias("units"))


@query("""SELECT key, CASE WHEN risk > 0 THEN round((reward::DECIMAL(18,0) * 1000000 // risk)::DECIMAL(38,0) / 1000000, 2)::DECIMAL(12,2) END AS ratio
FROM (SELECT key, CASE WHEN is_long THEN target_c - entry_c ELSE entry_c - target_c END AS reward, CASE WHEN is_long THEN entry_c - stop_c ELSE stop_c - entry_c END AS risk FROM watchlist)""")
def reward_risk(spark: SparkSession, sf: str) -> DataFrame:
    return watchlist(spark, sf).select("key", X.reward_risk(F.col("target_c"), F.col("entry_c"), F.col("stop_c"), F.col("is_long")).alias("ratio"))


@query("""SELECT key, CASE WHEN price_c IS NULL THEN 'No Data'
  WHEN stop_c <> 0 AND CASE WHEN is_long THEN price_c <= stop_c * 1.02::DOUBLE ELSE price_c >= stop_c * 0.98::DOUBLE END THEN 'Stop'
  WHEN entry_c <> 0 AND CASE WHEN is_long THEN price_c >= entry_c AND price_c <= entry_c * 1.02::DOUBLE ELSE price_c > entry_c * 0.98::DOUBLE AND price_c < entry_c END THEN 'Entry'
  WHEN target_c <> 0 AND abs(price_c - target_c) / target_c <= 0.02::DOUBLE THEN 'Target' ELSE 'Away' END AS proximity,
  CASE WHEN price_c <> 0 THEN abs((target_c - price_c) * 100.0::DOUBLE / price_c)::DECIMAL(18,4) END AS upside,
  CASE WHEN entry_c = 0 THEN 0 ELSE (CASE WHEN is_long THEN entry_c - price_c ELSE price_c - entry_c END * 100.0::DOUBLE / entry_c) END::DECIMAL(18,4) AS bte FROM watchlist""")
def proximity(spark: SparkSession, sf: str) -> DataFrame:
    """Status against the levels, distance to the target and how much better than the entry the price is."""
    w = watchlist(spark, sf)
    c = F.col
    better = F.when(c("is_long"), c("entry_c") - c("price_c")).otherwise(c("price_c") - c("entry_c"))
    return w.select(
        "key", X.proximity(c("price_c"), c("entry_c"), c("target_c"), c("stop_c"), c("is_long")).alias("proximity"),
        X.dec(F.when(c("price_c") != 0, F.abs((c("target_c") - c("price_c")) * F.lit(100.0) / c("price_c")))).alias("upside"),
        X.dec(F.when(c("entry_c") == 0, 0.0).otherwise(better * F.lit(100.0) / c("entry_c"))).alias("bte"),
    )


_RESAMPLE = "SELECT ticker, {} AS bucket, arg_min(open_c, d) AS open_c, max(high_c) AS high_c, min(low_c) AS low_c, arg_max(close_c, d) AS close_c, sum(volume)::BIGINT AS volume FROM bars GROUP BY ticker, bucket"


@query(_RESAMPLE.format("(date_trunc('week', d) + INTERVAL 6 DAY)::DATE"))
def resample_week(spark: SparkSession, sf: str) -> DataFrame:
    return O.resample(bars(spark, sf), "ticker", "d", O.week_end("d"))


@query(_RESAMPLE.format("last_day(d)"))
def resample_month(spark: SparkSession, sf: str) -> DataFrame:
    return O.resample(bars(spark, sf), "ticker", "d", F.last_day("d"))


@query("""SELECT ticker, d, (sum(close_c) OVER a / count(*) OVER a)::DECIMAL(18,4) AS sma50, (sum(close_c) OVER b / count(*) OVER b)::DECIMAL(18,4) AS sma200
FROM (SELECT *, max(d) OVER (PARTITION BY ticker) AS m FROM bars) WHERE d >= m - 300
WINDOW a AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING), b AS (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING)""")
def sma_50_200(spark: SparkSession, sf: str) -> DataFrame:
    """Moving averages over the last 300 calendar days of each ticker."""
    return recent_bars(spark, sf, 300).select("ticker", "d", *(X.dec(F.avg("close_c").over(O.rolling("ticker", "d", n))).alias(f"sma{n}") for n in (50, 200)))


@query("""SELECT ticker, d, tr, CASE WHEN count(tr) OVER w = 14 THEN (sum(tr) OVER w / 14)::DECIMAL(18,4) END AS atr FROM (
  SELECT ticker, d, greatest(high_c - low_c, abs(high_c - p), abs(low_c - p)) AS tr FROM (SELECT *, lag(close_c) OVER (PARTITION BY ticker ORDER BY d) AS p FROM bars))
WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 13 PRECEDING)""")
def atr14(spark: SparkSession, sf: str) -> DataFrame:
    w = O.rolling("ticker", "d", 14)
    return bars(spark, sf).select("ticker", "d", O.true_range("ticker", "d").alias("tr")).withColumn("atr", X.dec(O.full(F.avg("tr").over(w), "tr", w, 14)))


@query("""SELECT ticker, d, CASE WHEN count(*) OVER w = 252 THEN ((close_c - avg(close_c) OVER w) / nullif(stddev_samp(close_c) OVER w, 0))::DECIMAL(18,4) END AS z FROM bars
WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)""")
def zscore252(spark: SparkSession, sf: str) -> DataFrame:
    w = O.rolling("ticker", "d", 252)
    z = F.try_divide(F.col("close_c") - F.avg("close_c").over(w), F.stddev_samp("close_c").over(w))
    return bars(spark, sf).select("ticker", "d", X.dec(O.full(z, "close_c", w, 252)).alias("z"))


@query("SELECT ticker, d, (close_c * 100.0::DOUBLE / first_value(close_c) OVER (PARTITION BY ticker ORDER BY d))::DECIMAL(18,4) AS base100 FROM bars")
def base100(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("ticker", "d", X.dec(F.col("close_c") * F.lit(100.0) / F.first("close_c").over(Window.partitionBy("ticker").orderBy("d"))).alias("base100"))


@query("""SELECT ticker, bucket, (s / n)::DECIMAL(18,4) AS sma50 FROM (
  SELECT ticker, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS bucket, arg_max(s, d) AS s, arg_max(n, d) AS n FROM (
    SELECT ticker, d, sum(close_c) OVER w AS s, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING)) GROUP BY 1, 2)""")
def sma_asof_week(spark: SparkSession, sf: str) -> DataFrame:
    """The daily average as of each week's end."""
    daily = bars(spark, sf).select("ticker", "d", F.avg("close_c").over(O.rolling("ticker", "d", 50)).alias("a"))
    return daily.groupBy("ticker", O.week_end("d").alias("bucket")).agg(X.dec(F.max_by("a", "d")).alias("sma50"))


@query("SELECT ticker, d, level_c, close_c > level_c AS up FROM (SELECT *, 5000000 AS level_c, lag(close_c) OVER (PARTITION BY ticker ORDER BY d) AS p FROM (SELECT ticker, d, close_c * 100 AS close_c FROM bars)) WHERE (p <= level_c AND close_c > level_c) OR (p >= level_c AND close_c < level_c)")
def level_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which the close crosses a level."""
    before = F.lag("close_c").over(Window.partitionBy("ticker").orderBy("d"))
    b = bars(spark, sf).select("ticker", "d", (F.col("close_c") * 100).alias("close_c"), F.lit(5_000_000).alias("level_c")).withColumn("p", before)
    return b.where("(p <= level_c AND close_c > level_c) OR (p >= level_c AND close_c < level_c)").select("ticker", "d", "level_c", (F.col("close_c") > F.col("level_c")).alias("up"))


@query("SELECT ticker, d, open_c, CASE WHEN d >= DATE '1997-01-01' THEN close_c + 1 ELSE close_c END AS close_c FROM bars WHERE d < DATE '1998-01-01' OR d >= DATE '1997-01-01'")
def upsert_close(spark: SparkSession, sf: str) -> DataFrame:
    """A delta that overlaps the base: closes are taken from it, rows that the base lacks are added."""
    sides = F.filter(F.array(F.when(F.col("d") < F.lit("1998-01-01").cast("date"), 0), F.when(F.col("d") >= F.lit("1997-01-01").cast("date"), 1)), lambda s: s.isNotNull())
    both = bars(spark, sf).select("ticker", "d", "open_c", "close_c", F.explode(sides).alias("side"))
    return O.upsert_sides(both.withColumn("close_c", F.col("close_c") + F.col("side")), ["ticker", "d"], ["close_c"], "side")


@query("SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def insert_if_absent_day(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    base = e.where("day < DATE '2024-01-15'").distinct()
    return O.insert_if_absent(base, e.where("day >= DATE '2024-01-10'"), ["user_id", "event_type", "day"])


@query("SELECT key, period_end, min(id) AS id FROM fundamentals GROUP BY key, period_end")
def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return O.keep_first(fundamentals(spark, sf).select("key", "period_end", "id"), ["key", "period_end"], "id")


@query("""SELECT key, kind, price_c FROM (SELECT key, 'entry' AS kind, entry_c AS price_c FROM watchlist UNION ALL SELECT key, 'target', target_c FROM watchlist UNION ALL SELECT key, 'stop_loss', stop_c FROM watchlist) l
WHERE price_c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fundamentals f WHERE f.key = l.key AND f.heps_c < 100000)""")
def melt_levels_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    long = watchlist(spark, sf).select("key", F.expr("stack(3, 'entry', entry_c, 'target', target_c, 'stop_loss', stop_c) AS (kind, price_c)")).where("price_c IS NOT NULL")
    return long.join(fundamentals(spark, sf).where("heps_c < 100000"), "key", "left_anti")


@query("""SELECT event_id, event_type, (json_extract(props, '$.k'))::BIGINT AS k, '{"channel":"' || event_type || '","id":' || event_id || '}' AS payload FROM events""")
def json_payload(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("event_type").alias("channel"), F.col("event_id").alias("id")))
    return table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), payload.alias("payload"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, sha256(p_name) AS digest, length(p_name) AS n FROM part")
def slug_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), F.sha2("p_name", 256).alias("digest"), F.length("p_name").alias("n"))


@query("SELECT conv_id, turn, left(coalesce(nullif(string_split(trim(CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END, ' \n\r\t'), '\n')[1], ''), 'No content'), 200) AS line FROM conversations")
def first_line(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.substring(T.headline(text, "No content"), 1, 200).alias("line"))


@query("SELECT ticker, min(low_c) AS low_c, max(high_c) AS high_c, count(*) FILTER (close_c < open_c) AS falls, median(close_c) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM bars) WHERE k <= 100 GROUP BY ticker")
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    """Range, falling days and exact median of the last hundred bars."""
    last = bars(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where("k <= 100")
    return last.groupBy("ticker").agg(F.min("low_c").alias("low_c"), F.max("high_c").alias("high_c"), F.count_if(F.col("close_c") < F.col("open_c")).alias("falls"), F.median("close_c").alias("mid"))


from larkspur.plans import changes, files, lists, pages, reports, series, streams, temporal, texts, versions, web, zones  # noqa: E402, F401  they register their queries
