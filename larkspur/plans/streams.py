"""Queries over streams: tables arrive block by block, a stream reads what has come, stops, and goes on from its checkpoint.

Every query plays all rows of its tables. What a sink holds in the end is what one batch over the whole table gives.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur import streaming
from larkspur.plans.registry import query
from larkspur.sources import table
from larkspur.sources.versions import Versions, shared_dir
from larkspur.streaming import levels

#: No user is forgotten within the month that the events span.
IDLE = timedelta(days=60)
#: Half of a month, then the rest.
HALVES = ("ts < TIMESTAMP_NTZ '2024-01-16'", "ts >= TIMESTAMP_NTZ '2024-01-16'")


def _played(rows: DataFrame, blocks: tuple[str, ...], start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """Appends each block to a folder and has ``start`` read what has come so far; returns the checkpoint's folder."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    for block in blocks:
        rows.where(block).write.mode("append").parquet(f"{folder}/in")
        start(streaming.read(spark, f"{folder}/in", rows), f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/checkpoint"


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value_c, ts) AS value_c FROM (SELECT *, floor(value * 100)::BIGINT AS value_c FROM events) GROUP BY user_id")
def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user, kept up to date in a table; the second block holds older rows than the first."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("value_c"))
    t = Versions(spark, shared_dir(spark), e.schema, ["user_id"], "pmod(xxhash64(user_id), 16)")
    feed = streaming.Feed()
    feed.subscribe("", lambda rows, n: t.merge(rows.select("user_id", "row.*"), e.columns[1:], ("latest", n)))
    odd = "pmod(event_id, 3) = 0"
    _played(e, (odd, f"NOT {odd}"), lambda s, checkpoint: feed.start(streaming.latest(s, "user_id", "ts"), checkpoint, "", "update"))
    return t.read()


@query("SELECT user_id, event_type, ts::DATE AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Each (user, type, day) once, by its first event: the newest days come first, the oldest last, none is too late."""
    e = table(spark, sf, "events")
    rows = e.select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "event_id")
    t = Versions(spark, shared_dir(spark), rows.schema, ["user_id", "event_type", "day"], "date_format(day, 'yyyy-MM-dd')")
    feed = streaming.Feed()
    feed.subscribe("", t.ingest("feed", ["event_id"]))
    _played(rows, ("day >= DATE '2024-01-20'", "day < DATE '2024-01-10'", "day >= DATE '2024-01-10' AND day < DATE '2024-01-20'"), lambda s, checkpoint: feed.start(s, checkpoint, ""))
    return t.read()


_NOTE = "'{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"note\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"' || event_type || '\"' END || '}'"


@query(f"""SELECT name, channel, event_id, {_NOTE} AS payload FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'trades' WHEN 'error' THEN 'faults' END AS channel FROM events)
JOIN (VALUES ('desk', 'trades', false), ('shaky', 'trades', false), ('leaver', 'trades', true), ('desk', 'faults', false)) AS s(name, channel, first_half) USING (channel) WHERE NOT first_half OR ts < TIMESTAMP '2024-01-16'""")
def stream_callbacks(spark: SparkSession, sf: str) -> DataFrame:
    """What each callback of two channels has got: one fails at first and is handed its batch again, one leaves half-way."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("note"))
    got = spark.createDataFrame([], "name string, channel string, event_id long, payload string")
    t = Versions(spark, shared_dir(spark), got.schema, ["name", "channel", "event_id"], "concat_ws('-', name, channel, pmod(event_id, 4))")
    well = []

    def keep(name: str, rows: DataFrame) -> None:
        t.insert_absent(rows.select(F.lit(name).alias("name"), "channel", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), "payload"), ["payload"])

    def desk(rows: DataFrame, number: int) -> None:
        keep("desk", rows)

    def shaky(rows: DataFrame, number: int) -> None:
        if not well:
            raise ConnectionError("not there yet")
        keep("shaky", rows)

    def leaver(rows: DataFrame, number: int) -> None:
        keep("leaver", rows)

    feed = streaming.Feed()
    for channel, callback in (("trades", shaky), ("trades", desk), ("trades", leaver), ("faults", desk)):
        feed.subscribe(channel, callback)

    def start(s: DataFrame, checkpoint: str) -> StreamingQuery:
        if feed.queries:
            feed.unsubscribe("trades", leaver)
            well.append(True)
        told = [streaming.changes(s.where(F.col("event_type") == kind), channel, ["event_id", "user_id", "note"]) for kind, channel in (("purchase", "trades"), ("error", "faults"))]
        return feed.start(told[0].union(told[1]), checkpoint)

    checkpoint = _played(e, HALVES, start)
    left = feed.replay(spark, checkpoint)
    if left:
        raise RuntimeError(f"{left} batches are left")
    return t.read()


_LEVELS = """SELECT c_custkey * 10 + 1 AS level_id, c_custkey AS user_id, 100.0::DOUBLE AS level, TIMESTAMP '2024-01-01' AS since, TIMESTAMP '2100-01-01' AS until FROM customer UNION ALL SELECT c_custkey * 10 + 2, c_custkey, 250.5, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16' FROM customer
UNION ALL SELECT c_custkey * 10 + 2, c_custkey, 150.25, TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-24' FROM customer"""


@query(f"""SELECT user_id AS key, level_id, level, ts, price_c, up FROM (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events) JOIN ({_LEVELS}) USING (user_id),
LATERAL (SELECT floor(value * 100)::BIGINT AS price_c, value > level AS up) WHERE ts >= since AND ts < until AND ((last <= level AND level < value) OR (last >= level AND level > value))""")
def stream_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of users that values pass, with keyed state: one level stays, one is moved and then taken back while the stream runs."""
    e, users = table(spark, sf, "events"), table(spark, sf, "customer").select("c_custkey")
    ticker = lambda c: F.col(c).cast("string").alias("ticker")
    prices = e.select(ticker("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    set_ = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).cast("double").alias("level"), F.lit(d).cast("timestamp").alias("ts")) for i, v, d in ((1, 100.0, "2024-01-01"), (2, 250.5, "2024-01-01"), (2, 150.25, "2024-01-16"), (2, None, "2024-01-24"))))
    changes = users.select("c_custkey", F.inline(set_)).select(ticker("c_custkey"), "ts", (F.col("c_custkey") * 10 + F.col("i")).alias("level_id"), "level")
    t = Versions(spark, shared_dir(spark), spark.createDataFrame([], levels.EVENT).schema, ["ticker", "level_id", "ts"], "pmod(level_id, 8)")
    feed = streaming.Feed()
    feed.subscribe("", t.ingest("crossings", ["price"]))
    halves = tuple(h.replace("TIMESTAMP_NTZ", "TIMESTAMP") for h in HALVES)
    _played(levels.feed(prices, changes), halves, lambda s, checkpoint: feed.start(levels.crossings(s, idle=IDLE), checkpoint, ""))
    return t.read().select(F.col("ticker").cast("long").alias("key"), "level_id", "level", F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("price") * 100).cast("long").alias("price_c"), "up")
