"""Cases of the operators that SQL can't express, and the order of ordered queries."""

import datetime as dt
import os
import posixpath
import urllib.parse

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur import plans, streaming
from larkspur.functions import text as T
from larkspur.operators import changes, lists, series, zones
from larkspur.operators import text as OT
from larkspur.sources import bars, html

SF = "/root/testdata/sf0.001"
ORDERED = ("watchlist_ordered", "valuation_queue", "update_queue", "todo_list", "status_event_sort", "column_sort", "find_names", "universe", "longest_texts", "valid_bars")


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert [tuple(map(str, r)) for r in plans.QUERIES[name](spark, SF).select(*names).collect()] == [tuple(map(str, r)) for r in want.fetchall()]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0)], "k int, v double")
    got = lambda name, reverse: [r["k"] for r in df.withColumnRenamed("v", name).orderBy(lists.column_order(name, reverse)).collect()]
    assert got("bte", False) == got("upside", False) == [3, 1, 2]
    assert got("peg", True) == [1, 3, 2] and got("upside", True) == [2, 1, 3]


def test_percent_key(spark):
    texts = ["(0.5%) Entry", "(12%) Stop", "(1.23%) Target", "No Data", "", None]
    assert values(spark, [(t,) for t in texts], "t string", T.percent_key(F.col("t"))) == [(0.5,), (12.0,), (1.23,), (float("inf"),), (float("inf"),), (float("inf"),)]


@pytest.mark.parametrize(
    ("lines", "kept", "reason"),
    [
        (["a", "Produced by the JSE SENS Department", "more"], 1, "cut_at_produced_by"),
        (["a"] * 9 + ["Sponsor", "", "Bank", "", "x", "Date: 01-02-2024"], 12, "cut_after_sponsor_block"),
        (["Sponsor"] + ["a"] * 9 + ["Date: 1/2/24"], 10, "cut_at_date_line"),
        (["a"] * 6 + ["Sponsor", "Bank"], 8, "no_change"),
        (["Date: 1/2/24"] + ["a"] * 9, 10, "no_change"),
    ],
)
def test_footers(spark, lines, kept, reason):
    text = "\r\n".join(lines)
    row = OT.trimmed(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    want = "\n".join(lines[:kept]).strip("\n") + "\n"
    assert (row["t"], row["reason"], row["trimmed_chars"]) == (want, reason, len(want))


def test_empty_footers(spark):
    rows = OT.trimmed(spark.createDataFrame([(1, None), (2, " \n ")], "k int, t string"), "k", "t").collect()
    assert {(r["t"], r["reason"], r["original_chars"]) for r in rows} == {("", "empty", 0)}


def test_links(spark):
    page = "http://site.example/x/y/page.aspx?q=1"
    links = ["../a/./b.pdf?x=1#y", "/PDF/c.pdf", "https://h.example/ost/PDF/d.pdf", "..\\..\\e.pdf", "folder/", "f.html?id=3", "a//b/../c", "../../../up", "//other.example/z", " "]

    def want(link):
        value = link.replace("\\", "/").strip()
        if not value:
            return None
        parts = urllib.parse.urlsplit(urllib.parse.urljoin(page, value))
        path = posixpath.normpath(parts.path)
        path = "/" + path.lstrip("/") + ("/" if parts.path.endswith("/") and not path.endswith("/") else "")
        return urllib.parse.urlunsplit((parts.scheme, parts.netloc, path, parts.query, parts.fragment))

    got = values(spark, [(x,) for x in links], "t string", T.absolute_url(F.lit(page), F.col("t")))
    assert [g[0] for g in got] == [want(x) for x in links]
    places = values(spark, [("http://h/PDF/a",), ("http://h/ost/PDF/a",), ("http://h/a",)], "t string", T.other_places(F.col("t")))
    assert [p[0] for p in places] == [["http://h/PDF/a", "http://h/ost/PDF/a", "http://h/ost/sp/profilem/PDF/a"], ["http://h/ost/PDF/a", "http://h/ost/sp/profilem/PDF/a"], ["http://h/a"]]


def test_reports(spark):
    long = "# x " + "word " * 120
    rows = [(None,), ("  ",), ("short",), ("Sorry, " + "x" * 600,), ("x" * 600,), ("x" * 2000,), (long,)]
    assert [r[0] for r in values(spark, rows, "t string", T.report_fault(F.col("t")))] == ["empty", "empty", "short", "failed", "plain", None, None]
    assert [r[0] for r in values(spark, [(None,), (" ",), ("N/A",), ("x",)], "t string", T.is_research(F.col("t")))] == [False, False, False, True]


def test_schedule(spark):
    times = [(dt.datetime(2024, 1, 31, 7, 0),), (dt.datetime(2024, 1, 31, 22, 30),), (dt.datetime(2024, 1, 31, 6, 59),), (dt.datetime(2024, 2, 3, 12, 0),)]
    assert values(spark, times, "t timestamp", X.at_work(F.col("t")), X.poll_seconds(F.col("t"))) == [(True, 900), (True, 900), (False, 600), (False, 600)]


def zone(kind, mid, score):
    return ("T", kind, mid - 0.5, mid + 0.5, mid, 3, 0, 0, 0, score)


ZONES = [zone("support", 10.0, 2.0), zone("support", 20.0, 1.5), zone("support", 30.0, 1.0), zone("resistance", 15.0, 2.0), zone("resistance", 25.0, 1.2), zone("resistance", 35.0, 0.9)]


@pytest.mark.parametrize(
    ("is_long", "entry", "stop", "target", "want"),
    [(True, 25.0, 12.0, 32.0, (20.0, 25.0)), (False, 20.0, 40.0, 12.0, (20.0, 25.0)), (True, 25.0, None, None, (10.0, 35.0)), (True, 5.0, 1.0, 9.0, (None, None)), (True, None, None, None, (10.0, 15.0))],
)
def test_pick(spark, is_long, entry, stop, target, want):
    trade = spark.createDataFrame([("T", is_long, entry, stop, target)], "ticker string, is_long boolean, entry double, stop double, target double")
    row = zones.pick(trade, spark.createDataFrame(ZONES, zones.SCHEMA)).first()
    assert (row["support"], row["resistance"]) == want


@pytest.mark.parametrize(
    ("entry", "stop", "target", "supports", "resistances"),
    [(5.0, 1.0, 12.0, [10.0], [15.0]), (28.0, 26.0, 29.0, [20.0], [35.0]), (None, 18.0, 32.0, [20.0, 30.0], [25.0]), (None, 1.0, 2.0, [10.0, 20.0, 30.0], [15.0, 25.0, 35.0]), (None, None, None, [10.0, 20.0, 30.0], [15.0, 25.0, 35.0])],
)
def test_levels(spark, entry, stop, target, supports, resistances):
    trade = spark.createDataFrame([("T", True, entry, stop, target)], "ticker string, is_long boolean, entry double, stop double, target double")
    row = zones.levels(trade, spark.createDataFrame(ZONES, zones.SCHEMA)).first()
    assert (row["supports"], row["resistances"]) == (supports, resistances)


def brute_zones(g, lookback=100, most=2):
    """Every step written out for one ticker's bars."""
    g = sorted(g)[-lookback:]
    high, low, close = ([float(x[k]) for x in g] for k in (1, 2, 3))
    n, tr = len(g), []
    for i in range(n):
        tr.append(high[i] - low[i] if i == 0 else max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])))
    atr = [np.mean(tr[i - 13 : i + 1]) * 0.8 if i >= 13 else None for i in range(n)]
    known = [a for a in atr if a is not None]
    tol = float(np.median([a if a is not None else known[0] for a in atr])) if known else 0
    tol = tol if tol > 0 else 0.005 * float(np.median(close))
    out = []
    for kind, line in (("resistance", high), ("support", low)):
        up = line if kind == "resistance" else [-x for x in line]
        tops, i = [], 1
        while i < n - 1:
            j = i
            while j + 1 < n and up[j + 1] == up[i]:
                j += 1
            if up[i - 1] < up[i] and j + 1 < n and up[j + 1] < up[i]:
                tops.append((i + j) // 2)
            i = j + 1
        left = set(tops)
        for t in sorted(tops, key=lambda t: (up[t], t), reverse=True):
            if t in left:
                left -= {m for m in left if m != t and abs(m - t) < 4}
        groups = []
        for v in sorted(line[t] for t in left):
            if groups and v - sum(groups[-1]) / len(groups[-1]) <= tol:
                groups[-1].append(v)
            else:
                groups.append([v])
        found = []
        for c in groups:
            if len(c) >= 2:
                last = max(t for t in left if c[0] - 1e-12 <= line[t] <= c[-1] + 1e-12)
                over = [i for i in range(n) if low[i] <= c[-1] and high[i] >= c[0]]
                rejected = [i for i in over if (close[i] < c[0] if kind == "resistance" else close[i] > c[-1])]
                score = len(c) * (1 + 0.35 * min(1, max(0, 1 - (n - 1 - last) / max(1, n - 1)))) + 0.75 * len(rejected)
                found.append((kind, c[0], c[-1], len(c), len(over), len(rejected), last, round(score, 9)))
        out += sorted(found, key=lambda z: (-z[-1], z[1]))[:most]
    return out


def test_zones(spark):
    b = bars(spark, SF).select("ticker", "d", "high_c", "low_c", "close_c").toPandas()
    got = {}
    for r in zones.detect(bars(spark, SF)).collect():
        got.setdefault(r["ticker"], []).append((r["kind"], r["low"], r["high"], r["touches"], r["tests"], r["rejections"], r["last_touch"], round(r["score"], 9)))
    for ticker, g in b.groupby("ticker"):
        assert sorted(got.get(ticker, [])) == sorted(brute_zones(list(g[["d", "high_c", "low_c", "close_c"]].itertuples(index=False, name=None)))), ticker
    x = "array(0D, 3D, 1D, 5D, 2D, 4D, 0D)"
    assert tuple(spark.range(1).select(*(F.expr(zones.prominence(x, p)) for p in "135")).first()) == (2, 5, 2)
    least = zones.detect(bars(spark, SF), prominence=3000.0).count()
    assert 0 < least <= zones.detect(bars(spark, SF)).count()


def test_changes(spark, tmp_path):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        changes.unique(s.union(s), ["k"])
    names = spark.createDataFrame([(1, 9)], "old int, new int")
    with pytest.raises(ValueError, match="refer"):
        changes.rename_keys(s, names, "k", [s])
    assert sorted(r["k"] for r in changes.rename_keys(s, names, "k", [s.where("k = 2")]).collect()) == [2, 9]
    changes.save(s, str(tmp_path / "snap"))
    changes.export(s, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.parquet(str(tmp_path / "snap")).count() == 2
    none = spark.createDataFrame([], "k int, v string")
    assert changes.affected(none, s, ["k"]).first()[:] == (0, 2) and changes.update_from(s, none, ["k"], ["v"]).count() == 2


def test_series(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None)], "t string, d int, x int")
    assert [tuple(r) for r in df.select("t", "d", series.filled("x", "t", "d")).orderBy("t", "d").collect()] == [("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 1, None)]
    pairs = spark.createDataFrame([("p", i, 100.0, 0.02) for i in range(3)], "k string, d int, a double, h double")
    got = series.discounts(pairs, "k", "d", "a", "h", 2).orderBy("d").collect()
    assert got[0]["mean"] is None and got[2]["deviation"] == 0 and got[2]["score"] is None


def test_pages(spark):
    broken = [(1, None), (2, ""), (3, "<table><tr><td>x"), (4, "<p></div></table><tr>")]
    df = spark.createDataFrame(broken, "page_id int, html string")
    assert html.share_statistics(df).count() == html.ratios(df).count() == html.headlines(df).count() == html.document_links(df).count() == 0
    assert [r["cell"] for r in html.tables(df).collect()] == ["x"]
    assert {r["content"] for r in html.element_text(df, "none").collect()} == {"No content"}


def test_files(spark, tmp_path):
    made = b"%PDF-1.4 /CreationDate (D:20240102030405+02'00') <x:xmpmeta><xmp:CreateDate>2023-05-06T07:08:09Z</xmp:CreateDate></x:xmpmeta>"
    for name, raw in (("a/x.pdf", made), ("a/y.pdf", b"no document"), ("b/z.pdf", b"%PDF /ModDate(D:2022)"), ("b/1.txt", b"one"), ("b/2.txt", b"two two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["created"] for r in html.documents(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": dt.datetime(2024, 1, 2, 3, 4, 5), "z.pdf": dt.datetime(2022, 1, 1)}
    assert html.document_day(None) is None
    texts = html.text_files(spark, str(tmp_path))
    assert {(r["folder"], r["text"]) for r in OT.held_text(texts, "folder", "name", "text", 9).collect()} == {("b", "one")}


def test_feed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id int, kind string, v int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, feed = [], streaming.Feed()

    def fails(df, n):
        raise RuntimeError("no")

    feed.subscribe("log", fails)
    feed.subscribe("log", lambda df, n: seen.extend(r["payload"] for r in df.collect()))
    stream = streaming.changes(streaming.read(spark, str(tmp_path / "in"), rows), "log", ["id", "v"])
    feed.start(stream, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(seen) == ['{"id":1,"v":null}', '{"id":2,"v":3}']
    feed.unsubscribe("log", fails)
    assert len(feed.callbacks["log"]) == 1
    feed.stop()
    assert not feed.callbacks and not feed.queries


def test_crosses(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    prices = spark.createDataFrame([("a", t(1), 9.0), ("a", t(2), 11.0), ("a", t(3), 10.5), ("a", t(4), 9.0), ("b", t(1), 11.0)], "ticker string, ts timestamp, price double")
    prices.coalesce(1).write.parquet(str(tmp_path / "in"))
    levels = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "ticker string, level double")
    seen = []
    streaming.dispatch(streaming.crosses(streaming.read(spark, str(tmp_path / "in"), prices), levels), [lambda df, n: seen.extend(df.collect())], str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r["ticker"], r["ts"], r["up"]) for r in seen) == [("a", t(2), True), ("a", t(4), False)]
    assert streaming.after(prices, "ts", "2024-01-01 00:03:00").count() == 1


def test_daily(spark, tmp_path):
    daily, done = streaming.Daily(spark, f"file://{tmp_path}"), []
    assert not daily.run("job", "2024-01-01", 60, 420, lambda: done.append(1))
    assert daily.run("job", "2024-01-01", 430, 420, lambda: done.append(1)) and not daily.run("job", "2024-01-01", 440, 420, lambda: done.append(2))
    with pytest.raises(ZeroDivisionError):
        daily.run("job", "2024-01-02", 430, 420, lambda: 1 / 0)
    assert daily.run("job", "2024-01-02", 445, 420, lambda: done.append(3)) and done == [1, 3]


def test_analyzer(spark):
    df = spark.createDataFrame([(1, "x")], "k int, p string")
    assert OT.analysed(df, "p", lambda s: s.str.upper()).first()["analysis"] == "X"
    assert OT.summary(pd.Series(["abc"])).iloc[0] == "# Analysis\nSignificance: Low\nabc"
