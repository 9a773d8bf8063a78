"""Change feeds: published changes, deduplicated appends, latest rows, crossed levels, jobs at set times."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

log = logging.getLogger(__name__)


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A folder of Parquet files as a stream with the schema of a batch frame."""
    return spark.readStream.schema(like.schema).parquet(folder)


def changes(stream: DataFrame, channel: str, columns: list[str]) -> DataFrame:
    """(channel, payload): every appended row, or new state of a row, as a JSON message; null values are in it too."""
    payload = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return stream.select(F.lit(channel).alias("channel"), payload.alias("payload"))


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once; state is bounded by the watermark, and rows that come later than it are dropped.

    Where any unseen key must be taken however late it is, write batches with
    ``insert_if_absent`` instead: exact, without state, at the cost of reading the keys that are there.
    """
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def latest(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of each key, for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("row"))


def after(stream: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows later than a cutoff, not those at it."""
    return stream.where(F.col(ts) > F.lit(cutoff).cast(stream.schema[ts].dataType))


def crosses(stream: DataFrame, levels: DataFrame, late: str = "1 day") -> DataFrame:
    """(ticker, level, ts, up): prices (ticker, ts, price) that pass a level (ticker, level) since the ticker's last price.

    State is the last price of each ticker, one row. Prices older than it are ignored.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ts, last = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "level"]).groupby("ts", sort=True):
            ts, group = row
            if last_ts is not None and ts <= last_ts:
                continue
            price = float(group["price"].iloc[0])
            if last is not None:
                out += [(key[0], float(v), ts, price > v) for v in group["level"] if (last <= v < price) or (last >= v > price)]
            last_ts, last = ts, price
        if last_ts is not None:
            state.update((last_ts.to_pydatetime(), last))
        yield pd.DataFrame(out, columns=["ticker", "level", "ts", "up"])

    both = stream.withWatermark("ts", late).join(levels, "ticker")
    return both.select("ticker", "ts", "price", "level").groupBy("ticker").applyInPandasWithState(step, "ticker string, level double, ts timestamp, up boolean", "ts timestamp, price double", "append", GroupStateTimeout.NoTimeout)


class Feed:
    """Callbacks by channel. One that fails doesn't keep the others, or later batches, from running; its batch is kept for ``replay``."""

    def __init__(self) -> None:
        self.callbacks: dict[str, list[Callable[[DataFrame, int], None]]] = {}
        self.queries: list[StreamingQuery] = []

    def subscribe(self, channel: str, callback: Callable[[DataFrame, int], None]) -> None:
        self.callbacks.setdefault(channel, []).append(callback)

    def unsubscribe(self, channel: str, callback: Callable[[DataFrame, int], None] | None = None) -> None:
        """Without a callback, all of the channel."""
        left = [f for f in self.callbacks.get(channel, []) if callback is not None and f is not callback]
        self.callbacks[channel] = left

    def start(self, stream: DataFrame, checkpoint: str, channel: str | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery:
        """Hands every batch to the callbacks of a channel, or of the channel that a row names; without ``every`` it stops at the end of the available input."""

        def each(batch: DataFrame, number: int) -> None:
            # Written once: state is brought forward once whatever the callbacks do, and all of them see the same rows.
            spark, path = batch.sparkSession, f"{_batches(checkpoint)}/{number}"
            batch.write.mode("overwrite").parquet(path)
            kept = spark.read.schema(batch.schema).parquet(path)
            names = [channel] if channel is not None else [r["channel"] for r in kept.select("channel").distinct().collect()]
            fs, folder = _folder(spark, path)
            failed = False
            for name in names:
                rows = kept if channel is not None else kept.where(F.col("channel") == name)
                for f in list(self.callbacks.get(name, [])):
                    try:
                        f(rows, number)
                    except Exception:
                        log.exception("a callback of %s failed for batch %s", name, number)
                        # Names that begin with _ are no data. The note says what is left to do, also after a restart.
                        out = fs.create(_folder(spark, f"{path}/_failed-{uuid.uuid4().hex}")[1], True)
                        out.write(bytearray(json.dumps({"channel": name, "callback": called(f), "number": number, "by_row": channel is None}).encode()))
                        out.close()
                        failed = True
            if not failed:
                fs.delete(folder, True)

        trigger = {"availableNow": True} if every is None else {"processingTime": every}
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(each).start()
        self.queries.append(query)
        return query

    def replay(self, spark: SparkSession, checkpoint: str) -> int:
        """Hands failed batches to the callbacks of the same name again, the oldest first; returns how many are still left."""
        fs, folder = _folder(spark, _batches(checkpoint))
        left = 0
        for batch in sorted(fs.listStatus(folder), key=lambda s: int(s.getPath().getName())) if fs.exists(folder) else ():
            path, open_ = batch.getPath(), 0
            for note in sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("_failed-")):
                said = json.loads(_text(spark, note))
                rows = spark.read.parquet(path.toString())
                rows = rows.where(F.col("channel") == said["channel"]) if said["by_row"] else rows
                again = [f for f in self.callbacks.get(said["channel"], []) if called(f) == said["callback"]]
                try:
                    for f in again:
                        f(rows, said["number"])
                except Exception:
                    log.exception("a callback of %s failed again for batch %s", said["channel"], said["number"])
                    again = []
                if again:
                    fs.delete(_folder(spark, note)[1], False)
                else:
                    open_ += 1
            if not open_:
                fs.delete(path, True)
            left += open_
        return left

    def stop(self) -> None:
        for query in self.queries:
            query.stop()
        self.queries.clear()
        self.callbacks.clear()


def called(f: Callable) -> str:
    """The name by which a callback is found again after a restart."""
    return f"{getattr(f, '__module__', '')}.{getattr(f, '__qualname__', type(f).__qualname__)}"


def _batches(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}-batches"


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text; Spark's readers skip names that begin with _."""
    fs, found = _folder(spark, path)
    stream = fs.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def dispatch(stream: DataFrame, callbacks: list[Callable[[DataFrame, int], None]], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that hands every batch to each callback and stops once the available input is read."""
    feed = Feed()
    for f in callbacks:
        feed.subscribe("", f)
    return feed.start(stream, checkpoint, "", mode)


class Daily:
    """Jobs that run once a day at most, from a set minute on; the days on which they ran are kept in a small file of the shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, job: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{job}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def ran(self, job: str, day: str) -> bool:
        fs, path = self._file(job)
        return fs.exists(path) and json.loads(self.spark.read.text(f"{self.folder}/{job}", wholetext=True).first()[0])["day"] >= day

    def run(self, job: str, day: str, minute: int, from_minute: int, work: Callable[[], None]) -> bool:
        """Whether the work was done now; a failure isn't noted, so the next round tries again."""
        if minute < from_minute or self.ran(job, day):
            return False
        work()
        fs, path = self._file(job)
        out = fs.create(path, True)
        out.writeBytes(json.dumps({"day": day}))
        out.close()
        return True
