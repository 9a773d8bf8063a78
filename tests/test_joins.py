"""Joins by order against brute force, with hot keys, ties, nulls and lengths of all sizes."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import joins


def rows(n, seed, hot=0.5):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", None])
    return [(i, key(), None if rng.random() < 0.05 else rng.randint(0, 60), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block", [None, 7])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof(spark, strict, block, tolerance):
    left, right = rows(120, 1), rows(90, 2)
    want = {}
    for i, k, t, _ in left:
        fits = [(rt, v is not None, v or 0, j) for j, rk, rt, v in right if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t)]
        best = max(fits, default=None)
        if best and tolerance is not None and best[0] < t - tolerance:
            best = None
        want[i] = (best[2] or None, best[3]) if best else (None, None)
    a = spark.createDataFrame(left, "id int, k string, t int, v int")
    b = spark.createDataFrame(right, "j int, k string, t int, w int").repartition(3)
    cut = None if block is None else lambda t: F.floor(t / block)
    got = joins.asof(a, b, ["k"], "t", ["w", "j"], None if tolerance is None else F.lit(tolerance), cut, strict)
    assert got.columns == ["id", "k", "t", "v", "w", "j"]
    assert {r["id"]: (r["w"], r["j"]) for r in got.collect()} == want


def test_asof_by_dates_and_tie(spark):
    day = date(2024, 1, 1)
    a = spark.createDataFrame([(1, day), (1, day + timedelta(40)), (2, None)], "k int, d date")
    b = spark.createDataFrame([(1, day, 1, "old"), (1, day, 2, "new"), (1, day + timedelta(3), 0, "far")], "k int, d date, n int, x string")
    got = joins.asof(a, b, ["k"], "d", ["x"], F.expr("INTERVAL 30 DAYS"), lambda d: F.trunc(d, "month"), tie=["n"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, day, "new"), (1, day + timedelta(40), None), (2, None, None)], key=str)


def test_asof_of_empty_sides(spark):
    a, none = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, t int, v int")
    assert [tuple(r) for r in joins.asof(a, none, ["k"], "t", ["v"], block=lambda t: F.floor(t / 2)).collect()] == [(1, 5, None)]
    assert joins.asof(none.select("k", "t"), none, ["k"], "t", ["v"]).collect() == []


def test_asof_of_a_hot_key_is_cut(spark):
    """With blocks no task of the sort holds the hot key's rows: they are dealt by block too."""
    a = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    b = a.select("k", "t", (F.col("t") * 2).alias("v"))
    got = joins.asof(a, b, ["k"], "t", ["v"], block=lambda t: F.floor(t / 100))
    assert got.where("v = t * 2").count() == 2000
    sizes = [len(p) for p in got.repartition(1).select("t").rdd.glom().collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum(sizes) == 2000 and "hashpartitioning(k0" in plan and plan.count("Window ") >= 2


def spans(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50))])
        hi = lo + rng.choice([0, 0, rng.uniform(0, 1), rng.uniform(0, 20), 300])
        out.append((i, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else lo, hi if rng.random() > 0.03 else lo - 1))
    return out


@pytest.mark.parametrize("width", [0.3, 5.0, 1000.0])
@pytest.mark.parametrize("slack", [0.0, 0.5])
def test_overlapping(spark, width, slack):
    left, right = spans(150, 1), spans(140, 2)
    want = sorted((i, j) for i, k, lo, hi in left for j, rk, a, b in right if k is not None and k == rk and lo is not None and a is not None and lo - slack <= hi + slack and a <= b and lo - slack <= b and a <= hi + slack)
    a = spark.createDataFrame(left, "i int, k string, lo double, hi double")
    b = spark.createDataFrame(right, "j int, k string, c double, d double")
    got = joins.overlapping(a, b, ["k"], ("lo", "hi"), ("c", "d"), width, slack)
    assert got.columns == ["i", "k", "lo", "hi", "j", "c", "d"]
    assert sorted((r["i"], r["j"]) for r in got.select("i", "j").collect()) == want


def test_rows_compared_follow_the_result(spark):
    """Two thousand short spans of one key beside a long one: the join makes few rows beyond the pairs."""
    a = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 10.0).alias("lo"), (F.col("id") * 10.0 + 3).alias("hi"))
    b = a.select("k", F.col("i").alias("j"), (F.col("lo") + 2).alias("c"), (F.col("hi") + 4).alias("d")).union(spark.createDataFrame([("k", -1, 0.0, 20_000.0)], "k string, j long, c double, d double"))
    got = joins.overlapping(a, b, ["k"], ("lo", "hi"), ("c", "d"), 4.0)
    assert got.count() == 4000
    bins = lambda lo, hi: {(level, n) for level in range(6) for n in range(int(lo // (4 * 8**level)), int(hi // (4 * 8**level)) + 1)}
    level = lambda lo, hi: next(n for n in range(6) if hi - lo <= 4 * 8**n)
    short = [(i * 10.0, i * 10.0 + 3) for i in range(2000)]
    others = [(lo + 2, hi + 4) for lo, hi in short]
    by_bin = {}
    for c, d in others:
        for n, x in bins(c, d):
            if n == level(c, d):
                by_bin[n, x] = by_bin.get((n, x), 0) + 1
    compared = sum(by_bin.get(k, 0) for lo, hi in short for k in bins(lo, hi))
    assert compared < 5 * 2000  # all pairs of the key would be 4,000,000


def test_empty_intervals(spark):
    none = spark.createDataFrame([], "k int, lo double, hi double")
    assert joins.overlapping(none, none.withColumnsRenamed({"lo": "c", "hi": "d"}), ["k"], ("lo", "hi"), ("c", "d"), 1.0).collect() == []
