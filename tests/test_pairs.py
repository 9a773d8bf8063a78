"""Pairs of series out of a table, each with its own window."""

from larkspur.operators import series as S


def test_paired(spark):
    bars = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5), ("b", 2, None), ("c", 2, 7), ("c", 1, 3)], "ticker string, d int, close_c long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), ("b", "b"), ("a", None), ("a", "none")], "asset string, holding string")
    got = sorted(tuple(r) for r in S.paired(bars, pairs).collect())
    assert got == [("a", "b", 1, 10, 5), ("a", "c", 1, 10, 3), ("a", "c", 2, 20, 7), ("b", "b", 1, 5, 5), ("c", "a", 1, 3, 10), ("c", "a", 2, 7, 20)]
    assert S.paired(bars, pairs.limit(0)).count() == 0 and S.paired(bars.limit(0), pairs).count() == 0


def test_windows_stay_apart(spark):
    one = [("a", "b", d, float(d % 7 + 1), 3.0 + d) for d in range(30)]
    other = [("a", "c", d, float(d % 5 + 2), 4.0) for d in range(30)]
    cols = "asset string, holding string, d int, asset_value double, holding_value double"
    score = lambda rows: {(r["holding"], r["d"]): r["score"] for r in S.discounts(spark.createDataFrame(rows, cols), ["asset", "holding"], "d", "asset_value", "holding_value", 10).collect()}
    both = score(one + other)
    assert both == score(one) | score(other) and sum(v is not None for v in both.values()) == 42
