"""Queries over versioned tables: merges of touched partitions, exact ingest, feeds of changes, views refreshed by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import operators as O
from larkspur.operators import references as R
from larkspur.operators import rollup
from larkspur.plans.changes import TODOS
from larkspur.plans.registry import query, relation
from larkspur.sources import bars, table, trades, watchlist
from larkspur.sources.versions import Versions, messages, refreshed, shared_dir


@query("SELECT ticker, d, open_c, CASE WHEN d >= DATE '1998-03-01' THEN close_c + 1 ELSE close_c END AS close_c FROM bars WHERE d >= DATE '1997-01-01'")
def partition_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Bars in a partition for each month; a delta of the last months reads and writes those alone."""
    b = bars(spark, sf).where("d >= DATE '1997-01-01'").select("ticker", "d", "open_c", "close_c")
    t = Versions(spark, shared_dir(spark), b.schema, ["ticker", "d"], "date_format(d, 'yyyy-MM')")
    t.merge(b.where("d < DATE '1998-06-01'"), ["close_c"])
    t.merge(b.where("d >= DATE '1998-03-01'").withColumn("close_c", F.col("close_c") + 1), ["close_c"])
    return t.read()


@query("SELECT user_id, event_type, ts::DATE AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def exact_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Batches that overlap, the newest rows first and the oldest last, one of them twice: each (user, type, day) is there once, by its first event."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    first = e.groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id"))
    t = Versions(spark, shared_dir(spark), first.schema, ["user_id", "event_type", "day"], "pmod(xxhash64(user_id, event_type, day), 16)")
    put = t.ingest("feed", ["event_id"])
    # Rows of one key never lie in two batches with different first events: batches are cut by day.
    for n, rows in ((0, e.where("day >= DATE '2024-01-20'")), (1, e.where("day >= DATE '2024-01-12' AND day < DATE '2024-01-25'")), (1, e.where("day >= DATE '2024-01-12' AND day < DATE '2024-01-25'")), (2, e.where("day < DATE '2024-01-15'"))):
        put(rows, n)
    return t.read()


_V2 = "SELECT id, CASE WHEN id % 7 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN NULL ELSE priority END AS priority FROM {todos} WHERE id % 5 <> 0 OR id % 3 = 0"
_V1 = "SELECT id, status, priority FROM {todos} WHERE id % 3 <> 0 OR id % 2 = 0"


@query(
    """SELECT op, id, '{"op":"' || op || '","id":' || id || ',"status":"' || s || '","priority":' || CASE WHEN p IS NULL THEN 'null' ELSE '"' || p || '"' END || '}' AS payload FROM (
  SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' WHEN a.status IS DISTINCT FROM b.status OR a.priority IS DISTINCT FROM b.priority THEN 'update' END AS op, CASE WHEN b.id IS NULL THEN a.status ELSE b.status END AS s, CASE WHEN b.id IS NULL THEN a.priority ELSE b.priority END AS p
  FROM one a FULL JOIN two b ON a.id = b.id) WHERE op IS NOT NULL""",
    todos=TODOS,
    one=_V1,
    two=_V2,
)
def change_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Inserted, updated and deleted rows between two versions of a table, as messages."""
    t = relation(spark, sf, TODOS)
    one, two = relation(spark, sf, _V1, todos=t), relation(spark, sf, _V2, todos=t)
    v = Versions(spark, shared_dir(spark), one.schema, ["id"], "pmod(id, 8)")
    v.merge(one, ["status", "priority"])
    v.replace(one.select("id").union(two.select("id")).distinct(), two)
    told = v.changes(1)
    return messages(told, "todos", ["id"]).select(F.get_json_object("payload", "$.op").alias("op"), F.get_json_object("payload", "$.id").cast("long").alias("id"), "payload")


@query("""SELECT w.key, coalesce(n, 0)::BIGINT AS n, last_ts, total_c FROM watchlist w LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_ts, sum(floor(value * 100)::BIGINT)::BIGINT AS total_c FROM events GROUP BY user_id) e ON w.key = e.user_id""")
def refreshed_view(spark: SparkSession, sf: str) -> DataFrame:
    """The watchlist with each key's events: made from the events up to a day, then refreshed for the keys that later ones name."""
    e = table(spark, sf, "events")
    rest = F.sum(F.floor(F.col("value") * 100).cast("long"))

    def view(events: DataFrame, keys: DataFrame) -> DataFrame:
        found = events.groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), rest.alias("total_c"))
        return keys.join(found, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), "last_ts", "total_c")

    keys, late = watchlist(spark, sf).select("key"), F.col("ts") >= F.lit("2024-01-28").cast("timestamp_ntz")
    before = view(e.where(~late), keys)
    changed = e.where(late).select(F.col("user_id").alias("key")).join(keys, "key", "left_semi")
    return refreshed(before, changed, lambda these: view(e.join(these, e["user_id"] == these["key"], "left_semi"), these), ["key"])


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    """States of all days, stored in two goes: late trades are merged into days that are there."""
    t = trades(spark, sf)
    day = rollup.states(t, "ticker", "d", "place", "c", "q")
    v = Versions(spark, shared_dir(spark), day.schema, ["ticker", "d"], "date_format(d, 'yyyy')")
    one = lambda rows: rollup.merged(rows, "ticker", "d")
    late = (F.col("q") % 5 == 0) & (F.col("d") >= F.lit("1997-01-01").cast("date"))
    v.combine(rollup.states(t.where(~late), "ticker", "d", "place", "c", "q"), one, ("days", 0))
    v.combine(rollup.states(t.where(late), "ticker", "d", "place", "c", "q"), one, ("days", 1))
    return v.read()


_TRADES = "(SELECT p_brand AS ticker, l_shipdate::DATE AS d, floor(l_extendedprice)::BIGINT AS c FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""SELECT b.*, n, (total / n)::DECIMAL(18,4) AS mean FROM (SELECT ticker, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS bucket, arg_min(open_c, d) AS open, max(high_c) AS high, min(low_c) AS low, arg_max(close_c, d) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY ticker, bucket) b
JOIN (SELECT ticker, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS bucket, count(*) AS n, sum(c)::BIGINT AS total FROM {_TRADES} GROUP BY ticker, bucket) t USING (ticker, bucket)""")
def rollup_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks and their mean trade, read from stored states of days."""
    return rollup.finished(_rolled(spark, sf), "ticker", O.week_end("d")).withColumn("mean", X.dec(F.col("mean")))


@query(f"SELECT ticker, last_day(d) AS bucket, count(*) AS n, (sum(c)::BIGINT / count(*))::DECIMAL(18,4) AS mean, (SELECT (sum(c)::BIGINT / count(*))::DECIMAL(18,4) FROM {_TRADES}) AS overall FROM {_TRADES} GROUP BY ticker, bucket")
def rollup_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means of months, and the overall one, weighted by the numbers in the same states."""
    v = _rolled(spark, sf)
    months = rollup.finished(v, "ticker", F.last_day("d")).select("ticker", "bucket", "n", X.dec(F.col("mean")).alias("mean"))
    return months.join(F.broadcast(rollup.average(v).select(X.dec(F.col("mean")).alias("overall"))))


#: The star's keys; a supplier that goes leaves its lines without one.
REFERENCES = [
    R.Reference("nation", "n_regionkey", "region", "r_regionkey"),
    R.Reference("customer", "c_nationkey", "nation", "n_nationkey"),
    R.Reference("supplier", "s_nationkey", "nation", "n_nationkey"),
    R.Reference("orders", "o_custkey", "customer", "c_custkey"),
    R.Reference("events", "user_id", "customer", "c_custkey"),
    R.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
    R.Reference("lineitem", "l_suppkey", "supplier", "s_suppkey", "null"),
]
_STAR = ("region", "nation", "customer", "supplier", "orders", "events", "lineitem")


@query("""SELECT * FROM (WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c))
SELECT 'region' AS name, count(*) AS n, 0 AS without FROM region WHERE r_regionkey NOT IN (1, 3) UNION ALL SELECT 'nation', count(*), 0 FROM nation WHERE n_regionkey NOT IN (1, 3) UNION ALL SELECT 'customer', count(*), 0 FROM customer WHERE c_custkey NOT IN (SELECT * FROM c) UNION ALL SELECT 'supplier', count(*), 0 FROM supplier WHERE s_suppkey NOT IN (SELECT * FROM s)
UNION ALL SELECT 'orders', count(*), 0 FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o) UNION ALL SELECT 'events', count(*), 0 FROM events WHERE user_id NOT IN (SELECT * FROM c) UNION ALL SELECT 'lineitem', count(*), count(*) FILTER (l_suppkey IN (SELECT * FROM s))::INT FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o))""")
def cascade_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left in every table when two regions go, and how many of them have lost their supplier."""
    tables = {n: table(spark, sf, n) for n in _STAR}
    left = R.delete(tables, REFERENCES, "region", tables["region"].where("r_regionkey IN (1, 3)").select("r_regionkey"))
    lost = lambda n: F.count_if(F.col("l_suppkey").isNull()).cast("int") if n == "lineitem" else F.lit(0)
    found = [left[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), lost(n).alias("without")) for n in _STAR]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query("""SELECT c_custkey AS key, 'orders' AS child, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 = 3 GROUP BY c_custkey UNION ALL SELECT c_custkey, 'events', count(*) FROM customer JOIN events ON user_id = c_custkey WHERE c_custkey % 10 = 3 GROUP BY c_custkey""")
def blocked_renames(spark: SparkSession, sf: str) -> DataFrame:
    """Of keys that are to be renamed those that can't be, and the rows that refer to them."""
    tables = {n: table(spark, sf, n) for n in _STAR}
    return R.blocked(tables, REFERENCES, "customer", tables["customer"].where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old"))).select("key", "child", "n")
