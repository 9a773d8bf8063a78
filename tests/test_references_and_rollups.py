"""Foreign keys over several levels, and roll-ups from merged states, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import references as R
from larkspur.operators import rollup


def tables(spark):
    return {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a_id int"),
        "c": spark.createDataFrame([(100, 10, 2), (101, 11, 1), (102, 12, None), (103, 12, 3)], "id int, b_id int, a_id int"),
        "d": spark.createDataFrame([(1000, 100), (1001, 103), (1002, None)], "id int, c_id int"),
    }


REFS = [R.Reference("d", "c_id", "c", "id", "null"), R.Reference("c", "b_id", "b", "id"), R.Reference("c", "a_id", "a", "id"), R.Reference("b", "a_id", "a", "id")]


def ids(found):
    return {n: sorted(r["id"] for r in df.collect()) for n, df in found.items()}


def test_cascade_through_levels(spark):
    t = tables(spark)
    left = R.delete(t, REFS, "a", spark.createDataFrame([(1,), (1,), (9,)], "id int"))
    # 100 goes with 10, 101 by its own reference though 11 stays.
    assert ids(left) == {"a": [2, 3], "b": [11, 12], "c": [102, 103], "d": [1000, 1001, 1002]}
    assert {r["id"]: r["c_id"] for r in left["d"].collect()} == {1000: None, 1001: 103, 1002: None}
    assert left["c"].columns == t["c"].columns
    assert ids(R.delete(t, REFS, "b", spark.createDataFrame([(None, 12)], "a_id int, id int"))) == {"a": [1, 2, 3], "b": [10, 11], "c": [100, 101], "d": [1000, 1001, 1002]}


def test_restricting_references(spark):
    t = tables(spark)
    refs = [*REFS[:3], R.Reference("b", "a_id", "a", "id", "restrict")]
    with pytest.raises(R.Refused, match="rows of b"):
        R.delete(t, refs, "a", spark.createDataFrame([(1,)], "id int"))
    assert ids(R.delete(t, refs, "a", spark.createDataFrame([(3,)], "id int")))["c"] == [100, 101, 102]
    with pytest.raises(ValueError, match="circle"):
        R.ordered([R.Reference("a", "x", "b", "y"), R.Reference("b", "x", "a", "y")])


def test_renames_that_must_fail(spark):
    t = tables(spark)
    names = lambda *rows: spark.createDataFrame(rows, "old int, new int")
    assert {tuple(r) for r in R.blocked(t, REFS, "a", spark.createDataFrame([(1,), (3,), (5,)], "old int")).collect()} == {(1, "c", "a_id", 1), (1, "b", "a_id", 1), (3, "c", "a_id", 1)}
    with pytest.raises(R.Refused, match="rows of b refer to 1"):
        R.rename(t, REFS, "a", "id", names((1, 7)))
    with pytest.raises(ValueError, match="not unique"):
        R.rename(t, REFS, "d", "id", names((1000, 1001)))
    assert ids({"d": R.rename(t, REFS, "d", "id", names((1000, 7)))}) == {"d": [7, 1001, 1002]}


@pytest.mark.parametrize("seed", range(3))
def test_states_merge_in_any_order(spark, seed):
    """However the trades are dealt, merged states give what one pass gives."""
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.randint(0, 9), i, rng.randint(1, 50), rng.randint(1, 9), rng.randint(0, 3)) for i in rng.sample(range(1000), 200)]
    t = spark.createDataFrame(rows, "k string, d int, at int, p int, q int, part int")
    stored = None
    for part in rng.sample(range(4), 4):
        new = rollup.states(t.where(F.col("part") == part), "k", "d", "at", "p", "q")
        stored = new if stored is None else rollup.merged(stored.unionByName(new), "k", "d")
    got = {(r["k"], r["bucket"]): tuple(r)[2:] for r in rollup.finished(stored, "k", F.floor(F.col("d") / 4)).collect()}
    want = {}
    for key in {(k, d // 4) for k, d, *_ in rows}:
        mine = sorted((d, at, p, q) for k, d, at, p, q, _ in rows if (k, d // 4) == key)
        prices = [m[2] for m in mine]
        want[key] = (prices[0], max(prices), min(prices), prices[-1], sum(m[3] for m in mine), len(mine), sum(prices) / len(prices))
    assert got == want
    whole = rollup.average(stored).first()
    assert whole["n"] == 200 and whole["mean"] == pytest.approx(sum(r[3] for r in rows) / 200)
