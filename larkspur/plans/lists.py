"""Queries over the watchlist: orders, filters, tags, latest levels, joins and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import operators as O
from larkspur.functions import text as T
from larkspur.operators import lists as L
from larkspur.plans.changes import LEVELS, TODOS
from larkspur.plans.registry import AS_OF, query, relation
from larkspur.sources import bars, fundamentals, table, watchlist



def today():
    return F.lit(AS_OF).cast("date")


#: The watchlist's states, some missing; research that is missing, blank or there; a day of it; names.
ENTRIES = """SELECT c_custkey AS key, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Active-Trade' WHEN 'MACHINERY' THEN 'Pre-Trade' WHEN 'FURNITURE' THEN 'WL-Sleep' WHEN 'AUTOMOBILE' THEN 'WL-Active' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS priority, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_name END AS research,
  CASE WHEN c_custkey % 5 > 1 THEN CAST(CASE WHEN c_custkey % 2 = 0 THEN '2024-01-31' ELSE '2024-01-02' END AS DATE) END AS research_day, c_custkey % 6 = 0 AS seen FROM {customer}"""
_FEED = "SELECT user_id AS key, count(*) FILTER (event_type = 'view' AND value > 90) AS unread, max(CASE WHEN event_type = 'purchase' AND value > 50 THEN 1 ELSE 0 END) = 1 AS holding FROM events GROUP BY user_id"
_RELEASES = "SELECT key, max(CASE WHEN k = 1 THEN period_end END) AS last, max(CASE WHEN k = 2 THEN period_end END) AS second, max(period_end) AS greatest FROM (SELECT key, period_end, row_number() OVER (PARTITION BY key ORDER BY period_end DESC NULLS FIRST, id DESC) AS k FROM results) GROUP BY key"
#: Results with a release date that is missing for some.
RESULTS = "SELECT o_custkey AS key, o_orderkey AS id, CASE WHEN o_orderkey % 25 <> 0 THEN CAST(o_orderdate AS DATE) END AS period_end FROM {orders}"
_ALL = f"SELECT e.*, coalesce(f.unread, 0)::BIGINT AS unread, coalesce(f.holding, false) AS holding, (r.second + INTERVAL 1 YEAR)::DATE AS event FROM entries e LEFT JOIN ({_FEED}) f ON e.key = f.key LEFT JOIN ({_RELEASES}) r ON e.key = r.key"


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Unread news and whether there is a holding, for each key: one aggregation."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("key")).agg(F.count_if((F.col("event_type") == "view") & (F.col("value") > 90)).alias("unread"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("holding"))


def releases(spark: SparkSession, sf: str) -> DataFrame:
    """The last, the last but one and the greatest release date of each key; a missing date counts as the last."""
    w = Window.partitionBy("key").orderBy(F.desc_nulls_first("period_end"), F.desc("id"))
    r = relation(spark, sf, RESULTS).withColumn("k", F.row_number().over(w))
    nth = lambda n: F.max(F.when(F.col("k") == n, F.col("period_end")))
    return r.groupBy("key").agg(nth(1).alias("last"), nth(2).alias("second"), F.max("period_end").alias("greatest"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """The whole list: states, research, unread news, holdings, the greatest release date, the next event."""
    rows = relation(spark, sf, ENTRIES).join(feed(spark, sf), "key", "left").join(releases(spark, sf).select("key", "second", "greatest"), "key", "left")
    return rows.withColumns({"unread": F.coalesce("unread", F.lit(0)), "holding": F.coalesce("holding", F.lit(False)), "event": F.add_months("second", 12)}).drop("second")


_RANK = "CASE WHEN priority = 'A' THEN 1 WHEN priority = 'B' THEN 2 ELSE 3 END"


def rank():
    return F.when(F.col("priority") == "A", 1).when(F.col("priority") == "B", 2).otherwise(3)


@query(
    f"""SELECT e.key, {_RANK} AS rank, status, coalesce(CASE WHEN e.key % 6 <> 0 THEN entry_c END, l.price_c) AS entry_c FROM entries e JOIN watchlist w ON e.key = w.key LEFT JOIN (
  SELECT key, price_c FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY added DESC NULLS FIRST, level_id DESC) AS k FROM levels WHERE level_type = 'entry') WHERE k = 1) l ON e.key = l.key ORDER BY rank, e.key""".replace("SELECT e.key, CASE", "SELECT e.key, CASE").replace("status,", "e.status,"),
    entries=ENTRIES, levels=LEVELS,
)
def watchlist_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """By priority and key; an entry price that isn't given is that of the newest entry level."""
    latest = O.nth_latest(relation(spark, sf, LEVELS).where("level_type = 'entry'"), "key", [F.desc_nulls_first("added"), F.desc("level_id")], 1)
    given = watchlist(spark, sf).select("key", F.when(F.col("key") % 6 != 0, F.col("entry_c")).alias("entry_c"))
    rows = relation(spark, sf, ENTRIES).select("key", rank().alias("rank"), "status").join(given, "key").join(latest.select("key", "price_c"), "key", "left")
    return rows.select("key", "rank", "status", F.coalesce("entry_c", "price_c").alias("entry_c")).orderBy("rank", "key")


@query(
    f"""SELECT key, greatest AS last_valuation, holding AS in_portfolio, priority FROM ({_ALL.replace("e.*", "e.*, r.greatest")}) WHERE event IS NULL OR event <= DATE '2024-01-31'
ORDER BY last_valuation ASC NULLS FIRST, in_portfolio DESC, priority ASC NULLS LAST, key""",
    entries=ENTRIES, results=RESULTS,
)
def valuation_queue(spark: SparkSession, sf: str, n: int | None = None) -> DataFrame:
    """Keys that need a valuation, those without one first; ``n`` bounds the list."""
    rows = entries(spark, sf).withColumnRenamed("greatest", "last_valuation")
    due = rows.where(F.col("event").isNull() | (F.col("event") <= today()))
    out = due.select("key", "last_valuation", F.col("holding").alias("in_portfolio"), "priority")
    return L.limited(out.orderBy(F.asc_nulls_first("last_valuation"), F.desc("in_portfolio"), F.asc_nulls_last("priority"), "key"), n)


@query(
    f"""SELECT key, last, due, in_portfolio, in_watchlist FROM (
  SELECT p.p_partkey AS key, r.last, CASE WHEN r.second IS NOT NULL THEN (r.second + INTERVAL 1 YEAR)::DATE ELSE r.last + 180 END AS due, coalesce(f.holding, false) AS in_portfolio, w.key IS NOT NULL AS in_watchlist
  FROM part p LEFT JOIN ({_RELEASES}) r ON p.p_partkey = r.key LEFT JOIN ({_FEED}) f ON p.p_partkey = f.key LEFT JOIN watchlist w ON p.p_partkey = w.key)
WHERE last IS NULL OR (DATE '2024-01-31' >= due AND DATE '2024-01-31' - last >= 150)
ORDER BY CASE WHEN last IS NULL THEN 1 ELSE 2 END, in_portfolio DESC, in_watchlist DESC, key""",
    results=RESULTS,
)
def update_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments whose results are due: without data first, then holdings, then the watchlist."""
    held = feed(spark, sf).select("key", "holding")
    listed = watchlist(spark, sf).select("key", F.lit(True).alias("listed"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key")).join(releases(spark, sf), "key", "left").join(held, "key", "left").join(listed, "key", "left")
    due = F.when(F.col("second").isNotNull(), F.add_months("second", 12)).otherwise(F.date_add("last", 180))
    rows = p.select("key", "last", due.alias("due"), F.coalesce("holding", F.lit(False)).alias("in_portfolio"), F.coalesce("listed", F.lit(False)).alias("in_watchlist"))
    rows = rows.where(F.col("last").isNull() | ((F.col("due") <= today()) & (F.datediff(today(), "last") >= 150)))
    return rows.orderBy(F.when(F.col("last").isNull(), 1).otherwise(2), F.desc("in_portfolio"), F.desc("in_watchlist"), "key")


@query(
    """SELECT id, status, priority, sort_order, created FROM todos
ORDER BY CASE status WHEN 'active' THEN 1 WHEN 'deferred' THEN 2 ELSE 3 END, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, sort_order ASC NULLS LAST, created, id""",
    todos=TODOS,
)
def todo_list(spark: SparkSession, sf: str) -> DataFrame:
    place = lambda c, first, second: F.when(F.col(c) == first, 1).when(F.col(c) == second, 2).otherwise(3)
    return relation(spark, sf, TODOS).orderBy(place("status", "active", "deferred"), place("priority", "high", "medium"), F.asc_nulls_last("sort_order"), "created", "id")


@query(
    f"""SELECT key, status, event FROM ({_ALL}) ORDER BY CASE status WHEN 'Active-Trade' THEN 0 WHEN 'Pre-Trade' THEN 1 WHEN 'WL-Active' THEN 2 ELSE 3 END, coalesce(event - DATE '2024-01-31', 999999), {_RANK}, key""",
    entries=ENTRIES, results=RESULTS,
)
def status_event_sort(spark: SparkSession, sf: str) -> DataFrame:
    """By state and days to the next event; equal rows stay in the list's own order."""
    e = entries(spark, sf)
    return e.orderBy(*L.by_state(e, today()), rank(), "key").select("key", "status", "event")


@query(
    f"""SELECT key, CASE WHEN unread > 0 THEN 'unread' WHEN research_day = DATE '2024-01-31' AND NOT seen THEN 'new_deepresearch' WHEN holding THEN 'holding' WHEN status = 'Pre-Trade' THEN 'pretrade' WHEN coalesce(research, '') = '' THEN 'no_research' ELSE '' END AS tag,
  coalesce((event - DATE '2024-01-31')::VARCHAR || 'd', '-') AS days, coalesce(event - DATE '2024-01-31' BETWEEN 0 AND 29, false) AS soon FROM ({_ALL})""",
    entries=ENTRIES, results=RESULTS,
)
def row_tag(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event")
    return entries(spark, sf).select("key", L.tag(today()).alias("tag"), L.days_text(event, today()).alias("days"), L.soon(event, today()).alias("soon"))


@query(
    f"""SELECT view, count(*) AS n FROM ({_ALL}) e, (VALUES ('all'), ('active'), ('sleep'), ('unread'), ('holding'), ('pre-trade'), ('no-research'), ('other')) v(view)
WHERE CASE view WHEN 'active' THEN status IS DISTINCT FROM 'WL-Sleep' WHEN 'sleep' THEN status IS NOT DISTINCT FROM 'WL-Sleep' WHEN 'unread' THEN unread > 0 WHEN 'holding' THEN holding WHEN 'pre-trade' THEN status IS NOT DISTINCT FROM 'Pre-Trade' WHEN 'no-research' THEN coalesce(trim(research), '') = '' ELSE true END GROUP BY view""",
    entries=ENTRIES, results=RESULTS,
)
def filtered_views(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each named filter leaves, in one pass; an unknown name leaves all."""
    named = {**L.views(), "other": F.lit(True)}
    counts = entries(spark, sf).agg(*(F.count_if(c).alias(k) for k, c in named.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("view"), F.col(f"`{k}`").alias("n")) for k in named))
    return counts.select(F.inline(pairs))


@query(
    f"""SELECT view, n FROM (SELECT '' AS view, 0 AS n) WHERE false UNION ALL SELECT 'unread', count(*) FROM ({_ALL}) WHERE unread > 0""",
    entries=ENTRIES, results=RESULTS,
)
def unread_view(spark: SparkSession, sf: str) -> DataFrame:
    return L.view(entries(spark, sf), " Unread ").agg(F.lit("unread").alias("view"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS unread, count(*) FILTER (event_type = 'view') > 3 AS many FROM events GROUP BY user_id")
def unread_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_if(F.col("event_type") == "view")
    return table(spark, sf, "events").groupBy("user_id").agg(n.alias("unread"), (n > 3).alias("many"))


@query("""SELECT key, bte FROM (SELECT key, CASE WHEN key % 8 <> 0 THEN (CASE WHEN is_long THEN entry_c - price_c ELSE price_c - entry_c END)::BIGINT END AS bte FROM watchlist) ORDER BY bte DESC NULLS LAST, key""")
def column_sort(spark: SparkSession, sf: str) -> DataFrame:
    """The list by one of its columns, reversed: missing values stay last."""
    better = F.when(F.col("is_long"), F.col("entry_c") - F.col("price_c")).otherwise(F.col("price_c") - F.col("entry_c"))
    return watchlist(spark, sf).select("key", F.when(F.col("key") % 8 != 0, better).alias("bte")).orderBy(L.column_order("bte", reverse=True), "key")


#: The columns that the list is sorted by, each with values that are missing or equal.
SORTED = """SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) WHEN c_custkey % 79 <> 0 THEN lower(c_name) END AS name, CASE WHEN c_custkey % 61 <> 0 THEN c_custkey * 7 % 400 - 30 END AS event, CASE WHEN c_custkey % 67 <> 0 THEN floor(c_acctbal / 100) END AS rr,
  CASE WHEN c_custkey % 71 <> 0 THEN floor(c_acctbal) END AS bte, CASE WHEN c_custkey % 73 <> 0 THEN c_custkey * 31 % 97 END AS upside, CASE WHEN c_custkey % 83 <> 0 THEN c_mktsegment END AS proximity, CASE WHEN c_custkey % 89 <> 0 THEN c_custkey * 13 % 89 END AS peg FROM {customer}"""
_SORTS = [(c, r) for c in ("event", "name", "rr", "bte", "upside", "proximity", "peg") for r in (False, True)]
_PAGE = 40  # rows of the list that are shown at once


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS sorted_by, {str(r).lower()} AS reversed, key, {c} IS NULL AS missing FROM sorted ORDER BY {"lower(name)" if c == "name" else c} {"DESC NULLS " + ("LAST" if c in ("bte", "peg") else "FIRST") if r else "ASC NULLS LAST"}, key LIMIT {_PAGE})""" for c, r in _SORTS), sorted=SORTED)
def column_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of the list by each of its columns, in both directions."""
    rows, out = relation(spark, sf, SORTED), None
    for c, r in _SORTS:
        page = rows.orderBy(L.column_order(c, r), "key").limit(_PAGE).select(F.lit(c).alias("sorted_by"), F.lit(r).alias("reversed"), "key", F.col(c).isNull().alias("missing"))
        out = page if out is None else out.unionByName(page)
    return out


@query("SELECT p_partkey AS key, upper(p_name) AS name FROM part WHERE p_name ILIKE '%a%' AND upper(p_brand) = upper('brand#12') AND p_partkey IS NOT NULL ORDER BY upper(p_name), key LIMIT 10")
def find_names(spark: SparkSession, sf: str) -> DataFrame:
    """Substrings and names in any case; the first ten by upper-case name."""
    p = table(spark, sf, "part").where(F.col("p_name").ilike("%a%") & (F.upper("p_brand") == F.upper(F.lit("brand#12"))) & F.col("p_partkey").isNotNull())
    return p.select(F.col("p_partkey").alias("key"), F.upper("p_name").alias("name")).orderBy("name", "key").limit(10)


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS status FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf: str, key: int = 7) -> DataFrame:
    """One row by its key: the filter reaches the scan."""
    return table(spark, sf, "customer").where(F.col("c_custkey") == key).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))


TICKERS = "SELECT p_partkey AS key, CASE p_partkey % 10 WHEN 0 THEN '^IX' || p_partkey WHEN 1 THEN ' ab' || p_partkey || '.jo ' WHEN 2 THEN 'CD' || p_partkey || '.JO' WHEN 3 THEN '' ELSE 'ef' || p_partkey END AS ticker FROM {part}"


@query("SELECT key, ticker, ticker LIKE '^%' AS is_index FROM tickers WHERE ticker NOT LIKE '^%' OR key % 20 = 0", tickers=TICKERS)
def index_split(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols that stand for indexes begin with a caret."""
    is_index = F.col("ticker").startswith("^")
    return relation(spark, sf, TICKERS).where(~is_index | (F.col("key") % 20 == 0)).select("key", "ticker", is_index.alias("is_index"))


@query("SELECT key, trim(ticker) AS ticker FROM tickers WHERE upper(regexp_replace(trim(ticker), '[.][jJ][oO]$', '')) IN (SELECT 'CD' || p_size FROM part)", tickers=TICKERS)
def held_only(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose symbol, without its suffix, is one of a list."""
    t = relation(spark, sf, TICKERS).withColumn("bare", F.upper(T.bare_ticker(F.col("ticker"))))
    known = table(spark, sf, "part").select(F.concat(F.lit("CD"), F.col("p_size")).alias("bare"))
    return t.join(known, "bare", "left_semi").select("key", F.trim("ticker").alias("ticker"))


@query("""SELECT key, min(rank) AS rank, arg_min(v, rank) AS value FROM (
  SELECT c.key, c.rank, max(o_orderdate)::DATE AS v FROM (SELECT s_suppkey AS key, s_suppkey * 7 AS cand, 0 AS rank FROM supplier UNION ALL SELECT s_suppkey, s_suppkey, 1 FROM supplier) c JOIN orders ON o_custkey = c.cand GROUP BY c.key, c.rank) GROUP BY key
UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT o_custkey FROM orders) AND s_suppkey * 7 NOT IN (SELECT o_custkey FROM orders)""".replace("min(rank) AS rank, ", "").replace("SELECT s_suppkey, NULL, NULL", "SELECT s_suppkey, NULL"))
def release_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """The newest date under the first of several keys that has any."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cand"), F.col("o_orderdate").cast("date").alias("day"))
    return L.first_variant(s, o, "key", F.array(F.col("key") * 7, F.col("key")), "cand", F.max("day"))


@query("""SELECT ticker, last, CASE WHEN last IS NULL THEN 'all' WHEN DATE '1998-12-01' - last <= 2 THEN 'short' ELSE 'range' END AS kind, CASE WHEN DATE '1998-12-01' - last > 2 THEN last + 1 END AS first_day, CASE WHEN DATE '1998-12-01' - last > 2 THEN DATE '1998-12-02' END AS end_day
FROM (SELECT p_brand AS ticker, max(d) AS last FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN bars ON ticker = p_brand AND p_brand <> 'Brand#11' GROUP BY p_brand)""")
def ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What to load for each symbol: everything, the last two days, or what is missing."""
    b = bars(spark, sf).where("ticker <> 'Brand#11'").groupBy("ticker").agg(F.max("d").alias("last"))
    every = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return every.join(b, "ticker", "left").select("ticker", "last", *X.ingest_window(F.col("last"), F.lit("1998-12-01").cast("date")))


@query("SELECT max(l_shipdate)::DATE AS last FROM lineitem")
def global_max(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.max("l_shipdate").cast("date").alias("last"))


GROUPS = "SELECT * FROM (VALUES ('BUILDING', 2, true), ('MACHINERY', 1, true), ('FURNITURE', 1, false), ('HOUSEHOLD', 1, true)) AS u(name, priority, is_active)"


@query("SELECT c_name AS symbol, g.priority FROM customer JOIN groups g ON g.name = c_mktsegment WHERE g.is_active ORDER BY g.priority, symbol", groups=GROUPS)
def universe(spark: SparkSession, sf: str) -> DataFrame:
    """The active instruments in order of their groups' priority; the groups are a literal relation."""
    groups = relation(spark, sf, GROUPS).where("is_active").select(F.col("name").alias("c_mktsegment"), "priority")
    found = table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), "c_mktsegment").join(F.broadcast(groups), "c_mktsegment")
    return found.select("symbol", "priority").orderBy("priority", "symbol")


@query("SELECT event_type, n, mean_c, (sum(mean_c * n) OVER () / sum(n) OVER ())::DECIMAL(18,4) AS overall_c FROM (SELECT event_type, count(*) AS n, sum(floor(value * 100)::BIGINT)::DOUBLE / count(*) AS mean_c FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type)".replace("SELECT event_type, n, mean_c, (", "SELECT event_type, n, mean_c::DECIMAL(18,4) AS mean_c, ("))
def overall_average(spark: SparkSession, sf: str) -> DataFrame:
    """Averages of each type, by number, and the overall one from them."""
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.floor(F.col("value") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("m"))
    whole = per.agg((F.sum(F.expr("m * n")) / F.sum("n")).alias("o"))
    return per.join(F.broadcast(whole)).select("event_type", "n", X.dec(F.col("m")).alias("mean_c"), X.dec(F.col("o")).alias("overall_c")).orderBy(F.desc("n"), "event_type")


@query("SELECT key, period_end, arg_max(id, k) AS id FROM (SELECT key, period_end, id, 0 AS k FROM results WHERE id % 2 = 0 UNION ALL SELECT key, period_end, id, 1 FROM results WHERE id % 3 = 0) WHERE id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key, period_end, id % 2 = 0 ORDER BY id) AS j FROM results) WHERE true) GROUP BY key, period_end".replace("arg_max(id, k)", "arg_max(id, (k, id))").replace(" WHERE id IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key, period_end, id % 2 = 0 ORDER BY id) AS j FROM results) WHERE true)", ""), results=RESULTS)
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Finals and interims in one list; of rows with the same date the later in the list stays."""
    r = relation(spark, sf, RESULTS)
    both = r.where("id % 2 = 0").withColumn("place", F.lit(0)).unionByName(r.where("id % 3 = 0").withColumn("place", F.lit(1)))
    return both.groupBy("key", "period_end").agg(F.max_by("id", F.struct("place", "id")).alias("id"))


@query("SELECT key, coalesce(min(CASE WHEN period_end >= DATE '1998-01-01' THEN period_end - DATE '1998-01-01' END), 999)::BIGINT AS days FROM results GROUP BY key", results=RESULTS)
def next_event(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, RESULTS).groupBy("key").agg(L.next_event_days(F.col("period_end"), F.lit("1998-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations ORDER BY n DESC, conv_id, turn LIMIT 5")
def longest_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n")).orderBy(F.desc("n"), "conv_id", "turn").limit(5)


@query("SELECT CASE WHEN n >= 10 THEN 'succeeded' WHEN n >= 3 THEN 'failed' ELSE 'skipped' END AS outcome, count(*) AS keys, sum(n)::BIGINT AS periods FROM (SELECT key, count(*) AS n FROM results GROUP BY key) GROUP BY outcome", results=RESULTS)
def run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    per = relation(spark, sf, RESULTS).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    outcome = F.when(F.col("n") >= 10, "succeeded").when(F.col("n") >= 3, "failed").otherwise("skipped")
    return per.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("periods"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE value > 30) WHERE k <= 3")
def success_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first three of each user that succeed; failures don't count."""
    return L.first_matches(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.col("event_id")], 3, F.col("value") > 30).select("user_id", "event_id")


@query("SELECT k AS key, next, previous FROM (SELECT s_suppkey AS k, s_nationkey AS g FROM supplier) JOIN (SELECT s_suppkey AS k, coalesce(lead(s_suppkey) OVER w, min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS next, coalesce(lag(s_suppkey) OVER w, max(s_suppkey) OVER (PARTITION BY s_nationkey)) AS previous FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) USING (k)")
def adjacent_wrap(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_nationkey")
    return L.neighbours(s, "key", "s_nationkey").select("key", "next", "previous")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 600")
def running_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation until their characters are used up."""
    c = table(spark, sf, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return L.within_budget(c, "conv_id", ["turn"], "n", 600).select("conv_id", "turn")


@query("SELECT w.key, l.price_c AS last_c, w.qty, (w.qty * coalesce(l.price_c, w.cost_c))::BIGINT AS value_c FROM (SELECT key, price_c AS cost_c, key % 9 + 1 AS qty FROM watchlist) w LEFT JOIN (SELECT key, arg_max(heps_c, (period_end, id)) AS price_c FROM fundamentals WHERE key % 2 = 0 GROUP BY key) l ON w.key = l.key")
def latest_price_left(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings with their latest price; those without one are worth what they cost."""
    f = fundamentals(spark, sf).where("key % 2 = 0").groupBy("key").agg(F.max_by("heps_c", F.struct("period_end", "id")).alias("last_c"))
    w = watchlist(spark, sf).select("key", F.col("price_c").alias("cost_c"), (F.col("key") % 9 + 1).alias("qty"))
    return w.join(f, "key", "left").select("key", "last_c", "qty", (F.col("qty") * F.coalesce("last_c", "cost_c")).alias("value_c"))


@query("SELECT o.o_custkey AS key, o.o_orderkey AS id, r.ratio FROM orders o LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) % 7 AS ratio FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) r ON o.o_custkey = r.o_custkey AND o.o_orderdate = r.o_orderdate")
def merge_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of the same period and key, the first if there are several."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), "o_orderdate")
    r = O.keep_first(o.where("id % 2 = 0"), ["key", "o_orderdate"], "id").select("key", "o_orderdate", (F.col("id") % 7).alias("ratio"))
    return o.join(r, ["key", "o_orderdate"], "left").select("key", "id", "ratio")


@query(
    """SELECT c_custkey AS key, 'R' || format('{:,.2f}', floor(c_acctbal * 100)::BIGINT / 100.0::DOUBLE) AS money, format('{:+.2f}%', (c_custkey % 1000 - 500) / 100.0::DOUBLE) AS change, CASE WHEN length(c_name) > 12 THEN left(c_name, 12) || '...' ELSE c_name END AS short, left(c_name, 10) AS ten FROM customer"""
)
def display_text(spark: SparkSession, sf: str) -> DataFrame:
    """Money, signed percentages and shortened texts as a list shows them."""
    c = table(spark, sf, "customer")
    change = (F.col("c_custkey") % 1000 - 500) / F.lit(100.0)
    return c.select(F.col("c_custkey").alias("key"), T.rands(F.floor(F.col("c_acctbal") * 100)).alias("money"), T.signed_percent(change).alias("change"), T.shortened(F.col("c_name"), 12).alias("short"), F.substring("c_name", 1, 10).alias("ten"))


@query("SELECT key, target_c >= entry_c AS is_long, target_c > entry_c AS strictly_long FROM watchlist")
def direction(spark: SparkSession, sf: str) -> DataFrame:
    """The direction that the levels imply; the two rules differ where they are equal."""
    entry, target = F.col("entry_c"), F.col("target_c")
    return watchlist(spark, sf).select("key", X.is_long(entry, target).alias("is_long"), X.is_long(entry, target, strict=True).alias("strictly_long"))


@query("""SELECT key, kind, (price_c / 100.0::DOUBLE)::DECIMAL(18,4) AS price FROM (SELECT key, 'entry' AS kind, entry_c AS price_c FROM watchlist UNION ALL SELECT key, 'target', target_c FROM watchlist UNION ALL SELECT key, 'stop_loss', stop_c FROM watchlist
UNION ALL SELECT key, level_type, price_c FROM levels WHERE level_type IN ('support', 'resistance')) WHERE price_c IS NOT NULL""", levels=LEVELS)
def level_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each level of a key: its own three, and all supports and resistances."""
    own = watchlist(spark, sf).select("key", F.expr("stack(3, 'entry', entry_c, 'target', target_c, 'stop_loss', stop_c) AS (kind, price_c)"))
    more = relation(spark, sf, LEVELS).where(F.col("level_type").isin("support", "resistance")).select("key", F.col("level_type").alias("kind"), "price_c")
    return own.union(more).where("price_c IS NOT NULL").select("key", "kind", X.dec(F.col("price_c") / F.lit(100.0)).alias("price"))
