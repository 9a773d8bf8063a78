"""Versioned tables, exact ingest, feeds of changes, failed callbacks and crossings, with failures in the middle."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from larkspur import streaming
from larkspur.sources.versions import Conflict, Versions, messages, refreshed
from larkspur.streaming import levels

SCHEMA = "k long, part int, v string, w long"


def versions(spark, tmp_path, name="t"):
    return Versions(spark, f"file://{tmp_path}/{name}", spark.createDataFrame([], SCHEMA).schema, ["k"], "pmod(k, 10)")


def frame(spark, rows):
    return spark.createDataFrame([(k, k % 10, v, w) for k, v, w in rows], SCHEMA)


def files(tmp_path, name="t"):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / name / "data") for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted((r["k"], r["v"], r["w"]) for r in df.collect())


def test_merge_touches_few_partitions(spark, tmp_path):
    t = versions(spark, tmp_path)
    assert t.version() == 0 and t.read().count() == 0
    assert t.merge(frame(spark, [(k, "a", k) for k in range(40)]), ["v"]) == 1
    before, first = files(tmp_path), t.manifest(1)["partitions"]
    assert t.merge(frame(spark, [(3, "b", -1), (13, "b", -1), (103, "new", 5)]), ["v"]) == 2
    after, second = files(tmp_path), t.manifest(2)["partitions"]
    assert {p for p in second if second[p] != first.get(p)} == {"3"}
    assert {f: m for f, m in after.items() if f in before} == before  # nothing that was there is written again
    want = sorted([(k, "b" if k in (3, 13) else "a", k) for k in range(40)] + [(103, "new", 5)])
    assert rows_of(t.read()) == want  # only ``v`` is taken for known keys
    assert rows_of(t.read(1)) == [(k, "a", k) for k in range(40)]  # older versions stay readable


def test_second_writer_is_refused(spark, tmp_path):
    t, other = versions(spark, tmp_path), versions(spark, tmp_path)
    t.merge(frame(spark, [(1, "a", 1)]), ["v"])
    base = other.version()
    t.merge(frame(spark, [(1, "b", 1)]), ["v"])
    with pytest.raises(Conflict):
        other.merge(frame(spark, [(1, "c", 1)]), ["v"], base=base)
    assert rows_of(t.read()) == [(1, "b", 1)]
    assert other.merge(frame(spark, [(1, "c", 1)]), ["v"]) == 3 and rows_of(t.read()) == [(1, "c", 1)]


def test_names_of_partitions(spark, tmp_path):
    t = Versions(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["k"], "v")
    with pytest.raises(ValueError, match="not a name"):
        t.merge(frame(spark, [(1, "a/b", 1)]), ["w"])
    t.merge(frame(spark, [(1, None, 1)]), ["w"])
    assert rows_of(t.read()) == [(1, None, 1)]


def test_replayed_batches_add_nothing(spark, tmp_path):
    """A stream whose sink dies after the write and before the commit gives the rows of batch SQL, late rows too."""
    rng = random.Random(2)
    rows = [(rng.randint(0, 300), f"v{i}", i) for i in range(1200)]
    parts = [rows[i : i + 200] for i in range(0, 1200, 200)]
    source = tmp_path / "in"
    for i, part in enumerate(parts):  # in order of arrival, which isn't the order of keys or times
        frame(spark, part).coalesce(1).write.parquet(str(source / f"{i:03d}"))
        os.utime(next(p for p in (source / f"{i:03d}").iterdir() if p.suffix == ".parquet"), (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    t, dies = versions(spark, tmp_path), {1, 3}
    put = t.ingest("feed", ["w"])

    def sink(batch, number):
        if number == 3 and number in dies:
            t._write(t._named(batch), [])  # files of an attempt that is never published
        else:
            put(batch, number)
        if number in dies:
            dies.remove(number)
            raise RuntimeError("lost")

    for _ in range(3):
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(sink).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001  the failure that we have planted
            continue
    want = {}
    for k, v, w in rows:
        want.setdefault(k, (k, v, w))
    assert rows_of(t.read()) == sorted(want.values()) and not dies
    assert t.manifest()["batches"] == {"feed": 5} and t.version() == 6


def test_feed_of_changes(spark, tmp_path):
    """Messages of every version, replayed onto an empty table, give the last version; they say what batch SQL says."""
    t = versions(spark, tmp_path)
    rng = random.Random(3)
    states = [{}]
    for n in range(1, 5):
        now = dict(states[-1])
        put = {rng.randint(0, 60): (rng.choice(["a", "b", None]), n) for _ in range(25)}
        gone = rng.sample(sorted(now), min(len(now), 6))
        for k in gone:
            now.pop(k)
        now |= put
        keys = spark.createDataFrame([(k,) for k in {*gone, *put}], "k long")
        assert t.replace(keys, frame(spark, [(k, *v) for k, v in put.items()])) == n
        states.append(now)
    replayed = {}
    for r in sorted(t.changes(0).collect(), key=lambda r: r["version"]):
        old, new = states[r["version"] - 1].get(r["k"]), states[r["version"]].get(r["k"])
        said = {"insert": old is None, "update": old is not None and new is not None and old != new, "delete": new is None}
        assert said[r["op"]]
        replayed[r["k"]] = None if r["after"] is None else (r["after"]["v"], r["after"]["w"])
    assert {k: v for k, v in replayed.items() if v is not None} == states[-1]
    n = sum(old.get(k) != new.get(k) for old, new in zip(states, states[1:]) for k in {*old, *new})
    assert t.changes(0).count() == n and t.changes(2).where("version <= 2").count() == 0 and t.changes(t.version()).count() == 0
    told = messages(t.changes(3), "things", ["k"]).first()
    assert told["version"] == 4 and told["channel"] == "things" and '"op":' in told["payload"]


def test_refresh_by_changed_keys(spark, tmp_path):
    """Only changed keys are made anew; the view is that of the whole recompute."""
    base = spark.createDataFrame([(i, i % 17, i) for i in range(400)], "id long, k long, x long")
    view = lambda rows: rows.groupBy("k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    new = base.where("k <> 5").withColumn("x", F.when(F.col("k") == 3, F.col("x") * 2).otherwise(F.col("x"))).union(spark.createDataFrame([(999, 40, 7)], "id long, k long, x long"))
    asked = []

    def rebuild(keys):
        asked.extend(r["k"] for r in keys.collect())
        return view(new.join(keys, "k", "left_semi"))

    changed = spark.createDataFrame([(3,), (5,), (40,), (3,)], "k long")
    got = refreshed(view(base), changed, rebuild, ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, view(new).collect())) and sorted(asked) == [3, 5, 40]


def test_failed_callbacks_are_replayed(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "channel string, x long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, broken = {"good": [], "bad": []}, [True]

    def good(df, n):
        seen["good"] += [r["x"] for r in df.collect()]

    def bad(df, n):
        if broken[0]:
            raise RuntimeError("down")
        seen["bad"] += [r["x"] for r in df.collect()]

    feed = streaming.Feed()
    for f in (good, bad):
        feed.subscribe("a", f)
    check = str(tmp_path / "c")
    feed.start(streaming.read(spark, str(tmp_path / "in"), rows), check).awaitTermination(120)
    assert sorted(seen["good"]) == [1, 3] and seen["bad"] == []
    assert feed.replay(spark, check) == 1  # still down
    again = streaming.Feed()  # as after a restart
    assert again.replay(spark, check) == 1  # nobody has subscribed yet
    again.subscribe("a", bad)
    broken[0] = False
    assert again.replay(spark, check) == 0 and sorted(seen["bad"]) == [1, 3] and sorted(seen["good"]) == [1, 3]
    assert again.replay(spark, check) == 0 and sorted(seen["bad"]) == [1, 3]


def test_crossings_with_changing_levels(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    far = 60 * 24 * 30
    batches = [
        ([("a", t(1), 9.0), ("a", t(2), 11.0), ("b", t(1), 5.0)], [("a", t(0), 1, 10.0), ("b", t(0), 1, 7.0)]),
        ([("a", t(4), 9.5), ("a", t(3), 20.0), ("b", t(5), 8.0)], [("a", t(4), 2, 9.8), ("a", t(5), 1, None)]),
        ([("a", t(6), 12.0)], [("a", t(3), 1, 11.0)]),  # an older change doesn't bring a level back
        ([("a", t(7), 9.0), ("c", t(far), 1.0)], []),  # the watermark moves past everything
        ([("c", t(far + 200), 2.0)], []),
        ([("b", t(far + 201), 1.0), ("b", t(far + 202), 9.0)], [("b", t(far + 202), 3, 4.0)]),  # b was forgotten, with its level
    ]
    ps, ls = "ticker string, ts timestamp, price double", "ticker string, ts timestamp, level_id long, level double"
    for i, (p, q) in enumerate(batches):
        levels.feed(spark.createDataFrame(p, ps), spark.createDataFrame(q, ls)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        os.utime(next(x for x in (tmp_path / f"in/{i}").iterdir() if x.suffix == ".parquet"), (1e9 + i, 1e9 + i))
    like = levels.feed(spark.createDataFrame([], ps), spark.createDataFrame([], ls))
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []
    streaming.dispatch(levels.crossings(stream, "1 hour", dt.timedelta(days=7)), [lambda df, n: seen.extend(df.collect())], str(tmp_path / "c")).awaitTermination(300)
    got = sorted((r["ticker"], r["level_id"], r["ts"], r["up"]) for r in seen)
    assert got == [("a", 1, t(2), True), ("a", 1, t(4), False), ("a", 2, t(4), False), ("a", 2, t(6), True), ("a", 2, t(7), False), ("b", 1, t(5), True), ("b", 3, t(far + 202), True)]
