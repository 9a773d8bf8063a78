"""Crossed levels with keyed state: levels may come, change and go while the stream runs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "ticker string, level_id long, level double, ts timestamp, price double, up boolean"


def feed(prices: DataFrame, levels: DataFrame) -> DataFrame:
    """Prices (ticker, ts, price) and levels (ticker, ts, level_id, level; a null level takes it back) as one stream."""
    p = prices.select("ticker", "ts", "price", F.lit(None).cast("long").alias("level_id"), F.lit(None).cast("double").alias("level"))
    return p.unionByName(levels.select("ticker", "ts", F.lit(None).cast("double").alias("price"), F.col("level_id").cast("long").alias("level_id"), F.col("level").cast("double").alias("level")))


class Crossing(StatefulProcessor):
    """State of a bucket of tickers: of each its last price with its time, its newest time and its levels by id.

    Tickers share a bucket as each call of a group has a cost of its own; a ticker's state is read and
    written once for each batch that has rows of it. One without rows for ``idle`` seconds is forgotten: when the
    watermark has passed it, it counts no more, and its state is removed by the bucket's next timer.
    """

    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tickers = handle.getMapState("tickers", "ticker string", "last_ms long, price double, newest long, ids array<long>, levels array<double>, since array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        # A level set at a price's time counts for that price.
        batch = pd.concat(list(rows)).sort_values(["ts", "level_id"], na_position="last", kind="stable")
        mark = timerValues.getCurrentWatermarkInMs()
        times = batch["ts"].to_numpy("datetime64[us]")
        by_ticker: dict[str, list[tuple]] = {}
        for row in zip(batch["ticker"].tolist(), range(len(batch)), (times.astype("int64") // 1000).tolist(), batch["price"].tolist(), batch["level_id"].tolist(), batch["level"].tolist(), strict=True):
            by_ticker.setdefault(row[0], []).append(row[1:])
        found = []
        for ticker, changes in by_ticker.items():
            kept = self.tickers.getValue((ticker,))
            if kept is None or kept[2] + self.idle <= mark:
                kept = (None, None, 0, [], [], [])
            last_ms, last, newest = kept[:3]
            levels = {i: (v, since) for i, v, since in zip(*kept[3:], strict=True)}
            for at, ms, price, level_id, level in changes:
                newest = max(newest, ms)
                if level_id == level_id and level_id is not None:
                    # The newest change of a level counts, whichever comes first.
                    if levels.get(int(level_id), (None, ms))[1] <= ms:
                        levels[int(level_id)] = (level if level == level else None, ms)
                elif price == price and price is not None and (last_ms is None or ms > last_ms):
                    if last is not None:
                        found += [(ticker, i, v, at, price, price > v) for i, (v, _) in sorted(levels.items()) if v is not None and (last <= v < price or last >= v > price)]
                    last_ms, last = ms, price
            self.tickers.updateValue((ticker,), (last_ms, last, newest, list(levels), [v for v, _ in levels.values()], [since for _, since in levels.values()]))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(int(times.max().astype("int64")) // 1000, mark) + self.idle)
        out = pd.DataFrame(found, columns=[c.split()[0] for c in EVENT.split(", ")])
        out["ts"] = batch["ts"].to_numpy()[out["ts"].to_numpy("int64")]
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        mark, left = timerValues.getCurrentWatermarkInMs(), False
        for ticker, kept in list(self.tickers.iterator()):
            if kept[2] + self.idle <= mark:
                self.tickers.removeKey(ticker)
            else:
                left = True
        if left:
            self.handle.registerTimer(mark + self.idle)
        yield pd.DataFrame([], columns=[c.split()[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def crossings(rows: DataFrame, late: str = "1 hour", idle: timedelta = timedelta(days=7), buckets: int = 1024) -> DataFrame:
    """Every level of a ticker that a price passes since the ticker's last price, for a ``feed``.

    Prices that aren't later than the ticker's last one are ignored; rows later than the
    watermark are dropped. A taken-back level is kept as such, so that an older change can't bring it back.
    A batch's rows of one of the ``buckets`` are held at once; their number stays the same for a checkpoint.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = rows.withWatermark("ts", late).withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets))).groupBy("bucket")
    return keyed.transformWithStateInPandas(Crossing(int(idle.total_seconds())), EVENT, "Append", "EventTime")
