"""Queries that change tables: updates, deletes, renames, retention, counts of affected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.functions import text as T
from larkspur.operators import changes as C
from larkspur.plans.registry import query, relation
from larkspur.sources import bars, fundamentals, table, watchlist

#: Price levels of each key: several of a type, some without a date.
LEVELS = """SELECT o_orderkey AS level_id, o_custkey AS key, CASE o_orderkey % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'target' WHEN 2 THEN 'stop_loss' WHEN 3 THEN 'support' ELSE 'resistance' END AS level_type,
  CAST(floor(o_totalprice) AS BIGINT) AS price_c, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS added FROM {orders}"""
#: Things to do, with states, priorities and an order that is missing for some.
TODOS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'done' ELSE 'deferred' END AS status,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 10 AS INT) END AS sort_order, CAST(o_orderdate AS DATE) AS created FROM {orders}"""
#: Files of each key: documents, news and others.
FILES = """SELECT l_orderkey % 500 AS key, CAST(l_shipdate AS DATE) AS day, CASE l_linenumber % 4 WHEN 0 THEN 'doc.pdf' WHEN 1 THEN 'news_a' WHEN 2 THEN 'page.HTML' ELSE 'table.csv' END AS name,
  count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3"""


@query("SELECT id, status, priority FROM todos WHERE id % 2 = 0 UNION ALL SELECT id + 1000000, 'active', NULL FROM todos WHERE id % 2 = 1", todos=TODOS)
def append_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = relation(spark, sf, TODOS)
    new = t.where("id % 2 = 1").select((F.col("id") + 1_000_000).alias("id"), F.lit("active").alias("status"))
    return C.append(t.where("id % 2 = 0").select("id", "status", "priority"), new)


@query("SELECT count(*) FILTER (key IN (SELECT key FROM fundamentals)) AS updated, count(*) FILTER (key NOT IN (SELECT key FROM fundamentals)) AS inserted FROM watchlist")
def update_else_insert_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a write of the whole watchlist would change and add."""
    return C.affected(fundamentals(spark, sf), watchlist(spark, sf).select("key"), ["key"])


@query(
    """SELECT level_id, key, level_type, CASE WHEN k = 1 AND key % 3 = 0 THEN -key ELSE price_c END AS price_c FROM (
  SELECT *, row_number() OVER (PARTITION BY key, level_type ORDER BY added DESC NULLS FIRST, level_id DESC) AS k FROM levels)
UNION ALL SELECT NULL, key, 'entry', -key FROM watchlist w WHERE key % 3 = 0 AND NOT EXISTS (SELECT 1 FROM levels l WHERE l.key = w.key AND level_type = 'entry')""".replace("AND key % 3 = 0 THEN", "AND level_type = 'entry' AND key % 3 = 0 THEN"),
    levels=LEVELS,
)
def set_latest_level(spark: SparkSession, sf: str) -> DataFrame:
    """The newest entry level of every third key is overwritten, or added where there is none."""
    levels = relation(spark, sf, LEVELS)
    new = watchlist(spark, sf).where("key % 3 = 0").select("key", F.lit("entry").alias("level_type"), (-F.col("key")).alias("price_c"))
    return C.update_latest(levels, new, ["key", "level_type"], [F.desc_nulls_first("added"), F.desc("level_id")], ["price_c"]).select("level_id", "key", "level_type", "price_c")


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'done' WHEN id % 4 = 1 THEN 'active' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN DATE '2024-01-31' WHEN id % 4 = 1 THEN NULL WHEN status = 'done' THEN created END AS completed FROM todos", todos=TODOS)
def complete_todos(spark: SparkSession, sf: str) -> DataFrame:
    """The day of completion is set when a state becomes done, and taken back when it becomes another."""
    t = relation(spark, sf, TODOS).withColumn("completed", F.when(F.col("status") == "done", F.col("created")))
    new = F.when(F.col("id") % 4 == 0, "done").when(F.col("id") % 4 == 1, "active")
    done = F.when(new == "done", F.lit("2024-01-31").cast("date"))
    return C.update(t, new.isNotNull(), status=new, completed=done).select("id", "status", "completed")


@query("""SELECT w.key, CASE WHEN l.key IS NOT NULL AND risk > 0 THEN round((reward::DECIMAL(18,0) * 1000000 // risk)::DECIMAL(38,0) / 1000000, 2)::DECIMAL(12,2) END AS ratio
FROM (SELECT key, CASE WHEN is_long THEN target_c - entry_c ELSE entry_c - target_c END AS reward, CASE WHEN is_long THEN entry_c - stop_c ELSE stop_c - entry_c END AS risk FROM watchlist) w LEFT JOIN (SELECT key FROM watchlist WHERE key % 2 = 0) l ON w.key = l.key""")
def backfill_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of half of the rows, from a derived table."""
    w = watchlist(spark, sf)
    base = w.select("key", F.lit(None).cast("decimal(12,2)").alias("ratio"))
    source = w.where("key % 2 = 0").select("key", X.reward_risk(F.col("target_c"), F.col("entry_c"), F.col("stop_c"), F.col("is_long")).alias("ratio"))
    return C.update_from(base, source, ["key"], ["ratio"])


GROUPS = "SELECT * FROM (VALUES ('Brand#1', 'Banks'), ('Brand#2', 'Mining'), ('Brand#3', 'Retail')) AS g(prefix, category)"


@query("SELECT p_partkey AS key, g.category FROM part LEFT JOIN groups g ON left(p_brand, 7) = g.prefix", groups=GROUPS)
def backfill_category(spark: SparkSession, sf: str) -> DataFrame:
    """A category for each list of symbols; the mapping is a literal relation of three rows."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.substring("p_brand", 1, 7).alias("prefix"))
    return p.join(F.broadcast(relation(spark, sf, GROUPS)), "prefix", "left").select("key", "category")


@query("""SELECT 'holdings' AS name, count(*) AS n FROM customer WHERE c_mktsegment <> 'FURNITURE' UNION ALL
SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') UNION ALL
SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')""")
def delete_with_children(spark: SparkSession, sf: str) -> DataFrame:
    """Rows left in three tables when keys go from the first and their references with them."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    tables = {"holdings": c, "orders": table(spark, sf, "orders"), "events": table(spark, sf, "events")}
    left = C.delete_cascade(tables, c.where("c_mktsegment = 'FURNITURE'"), "key", {"orders": "o_custkey", "events": "user_id"})
    counted = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    return counted[0].union(counted[1]).union(counted[2])


@query("SELECT key, CASE WHEN key % 5 = 0 THEN 'WL-Active' ELSE status END AS status, key % 5 <> 0 AND key IN (SELECT key FROM fundamentals) AS holding FROM watchlist")
def close_holding(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings go, and the status of their keys is set in the same job."""
    held = fundamentals(spark, sf).select("key").distinct()
    gone = watchlist(spark, sf).where("key % 5 = 0").select("key")
    left = C.delete(held, gone, ["key"]).withColumn("holding", F.lit(True))
    marked = C.update(watchlist(spark, sf), F.col("key") % 5 == 0, status=F.lit("WL-Active"))
    return marked.join(left, "key", "left").select("key", "status", F.coalesce("holding", F.lit(False)).alias("holding"))


@query("SELECT key, level_type, min(level_id) AS level_id FROM levels GROUP BY key, level_type", levels=LEVELS)
def dedupe_min_id_per_type(spark: SparkSession, sf: str) -> DataFrame:
    return C.keep_min_id(relation(spark, sf, LEVELS), ["key", "level_type"], "level_id").select("key", "level_type", "level_id")


@query("SELECT CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS key, s_name AS name FROM supplier")
def rename_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth key gets another name; no other table refers to them."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    names = s.where("key % 10 = 0").select(F.col("key").alias("old"), (F.col("key") + 1_000_000).alias("new"))
    return C.rename_keys(s, names, "key", [s.where("key < 0")])


@query("SELECT key, status FROM watchlist WHERE key % 2 = 0 UNION ALL SELECT key, 'Pending' FROM watchlist WHERE key % 2 = 1")
def add_pending(spark: SparkSession, sf: str) -> DataFrame:
    """New entries begin as pending; a key that is there already would be an error."""
    w = watchlist(spark, sf).select("key", "status")
    return C.unique(C.append(w.where("key % 2 = 0"), w.where("key % 2 = 1").select("key", F.lit("Pending").alias("status"))), ["key"])


@query("""SELECT key, day, name, NOT (starts_with(lower(name), 'news') OR regexp_matches(lower(name), '[.](pdf|html|htm|txt|json)$')) OR (name = 'doc.pdf' AND k = 1) AS kept
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name = 'doc.pdf' DESC, day DESC, name) AS k FROM files)""", files=FILES)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """The newest document of each key is kept, with files of other kinds."""
    return C.retained(relation(spark, sf, FILES).select("key", "day", "name"), "key", "name", "day")


@query("""SELECT key, day, name, CASE WHEN k = 0 THEN base ELSE replace(base, '.pdf', '') || '_' || k || '.pdf' END AS target FROM (
  SELECT *, strftime(day, '%Y%m%d') || '.pdf' AS base, row_number() OVER (PARTITION BY key, day ORDER BY name) - 1 AS k FROM files)""", files=FILES)
def target_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names by date, numbered where two files of a folder have the same day."""
    dated = relation(spark, sf, FILES).select("key", "day", "name", T.dated_name(F.col("day")).alias("base"))
    return C.free_names(dated, "key", "base", ["name"]).select("key", "day", "name", "target")


@query("SELECT ticker, d, CASE WHEN d >= DATE '1997-06-01' THEN close_c + 1 ELSE close_c END AS close_c, volume FROM bars")
def upsert_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert that takes the columns it is told to."""
    from larkspur import operators as O

    b = bars(spark, sf).select("ticker", "d", "close_c", "volume")
    return O.upsert(b, b.where("d >= DATE '1997-06-01'").withColumn("close_c", F.col("close_c") + 1), ["ticker", "d"], ["close_c", "volume"])
