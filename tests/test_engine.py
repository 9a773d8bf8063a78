"""Queries against DuckDB on the smallest tables, and small cases of the operators."""

import datetime as dt
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import operators as O
from larkspur import plans, streaming
from larkspur.operators import zones

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = lambda it: sorted(tuple(map(str, r)) for r in it)
    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_reward_risk(spark):
    rows = [(150, 100, 90, True, "5.00"), (80, 100, 110, False, "2.00"), (None, 100, 90, True, None), (150, 100, 100, True, None), (150, 100, 90, None, "5.00")]
    df = spark.createDataFrame(rows, "t int, e int, s int, l boolean, want string")
    for r in df.withColumn("got", X.reward_risk(F.col("t"), F.col("e"), F.col("s"), F.col("l")).cast("string")).collect():
        assert r["got"] == r["want"]


def test_proximity_bounds(spark):
    rows = [(None, 1000, 2000, 500, True, "No Data"), (510, 1000, 2000, 500, True, "Stop"), (1000, 1000, 2000, 500, True, "Entry"), (1020, 1000, 2000, 500, True, "Entry"), (1021, 1000, 2000, 500, True, "Away"), (1000, 1000, 500, 2000, False, "Away"), (999, 1000, 500, 2000, False, "Entry"), (1960, 1000, 2000, None, True, "Target")]
    df = spark.createDataFrame(rows, "p int, e int, t int, s int, l boolean, want string")
    for r in df.withColumn("got", X.proximity(*(F.col(c) for c in "petsl"))).collect():
        assert r["got"] == r["want"], r


def test_text(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(X.period_end(F.lit("Mar 2024 (12m)"))) == dt.date(2024, 3, 31) and one(X.period_end(F.lit("n/a"))) is None
    assert one(X.number(F.lit("−1 234.5"))) == -1234.5 and one(X.number(F.lit("1,234"))) is None and one(X.number(F.lit("N/A"))) is None
    assert one(X.significance(F.lit("Significance: HIGH today"))) == "High" and one(X.significance(F.lit("none"))) is None


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, v int")
    delta = spark.createDataFrame([(2, "x", 20), (3, "c", 30)], "k int, s string, v int")
    once = O.upsert(base, delta, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 20), (3, "c", 30)] == sorted(map(tuple, O.upsert(once, delta, ["k"], ["v"]).collect()))
    assert O.insert_if_absent(base, delta, ["k"]).count() == 3


def test_peaks(spark):
    rng = np.random.default_rng(1)
    rows = [[float(v) for v in rng.integers(0, 6, 30)] for _ in range(200)] + [[], [1.0], [1.0, 2.0], [1.0, 1.0, 1.0]]
    made = spark.createDataFrame(list(enumerate(rows)), "i int, x array<double>").select("i", F.expr(zones.peaks("x", 4)).alias("p"))
    got = {r["i"]: r["p"] for r in made.collect()}
    for row, x in enumerate(rows):
        inner = []
        i = 1
        while i < len(x) - 1:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
                inner.append((i + j) // 2)
            i = j + 1
        left = set(inner)
        for k in sorted(inner, key=lambda k: (x[k], k), reverse=True):
            if k in left:
                left -= {m for m in left if m != k and abs(m - k) < 4}
        assert got[row] == sorted(left)
    points = spark.createDataFrame([([(5.0, 0), (1.0, 1), (1.5, 2), (9.0, 3)],)], "v array<struct<x:double,p:int>>").select(F.expr(zones.clusters("v", "1.0D")).alias("c")).first()["c"]
    assert [(c["low"], c["high"], c["touches"], c["last_touch"]) for c in points] == [(1, 1.5, 2, 2), (5, 5, 1, 0), (9, 9, 1, 3)]


def test_streams(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2024, 1, 1, 0, 0)), (1, "b", dt.datetime(2024, 1, 1, 0, 5)), (2, "c", dt.datetime(2024, 1, 1, 0, 1))]
    batch = spark.createDataFrame(rows, "k int, v string, ts timestamp")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    for n, (frame, mode) in enumerate([(streaming.deduplicated(streaming.read(spark, str(tmp_path / "in"), batch), ["k"], "ts", "1 hour"), "append"), (streaming.latest(streaming.read(spark, str(tmp_path / "in"), batch), "k", "ts"), "complete")]):
        streaming.dispatch(frame, [lambda df, i: seen.append(df.collect())], str(tmp_path / f"c{n}"), mode).awaitTermination(120)
    first, last = [x for x in seen if x][0], [x for x in seen if x][-1]
    assert sorted(r["k"] for r in first) == [1, 2] and {r["k"]: r["row"]["v"] for r in last} == {1: "b", 2: "c"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
