"""Trees of pages with ends left out, and tables that are named."""

import random

from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.plans import reports
from larkspur.sources import html

LOOSE = "<table id=fin_S><tr><td>Period<th>Mar 2020<th>Sep 2019<tr><td>12 Month HEPS<td><b>1<td>2<tr><td>12 Month HEPS (again)<td>3</table><table id=fin_S><tr><td>later</table>"


def test_ends_left_out():
    root = html.Tree(LOOSE).root
    assert [html.cells(t) for t in root.all("table")] == [[["Period", "Mar 2020", "Sep 2019"], ["12 Month HEPS", "1", "2"], ["12 Month HEPS (again)", "3"]], [["later"]]]
    inner = html.Tree("<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>").root.all("table")
    assert [len(t.all("tr")) for t in inner] == [2, 1] and [c.text() for c in inner[1].all("td")] == ["b", "c"]
    items = html.Tree("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>").root.all("li")
    assert [x.text("|") for x in items] == ["a|b|c", "b", "c", "d"]


def test_named_tables(spark):
    pages = spark.createDataFrame([(1, LOOSE), (2, "<p>no table"), (3, None), (4, "")], "page_id int, html string")
    got = [(r["page_id"], r["name"], r["row_no"], r["row"]) for r in html.named_tables(pages, html.FINANCIALS).collect()]
    assert got == [(1, "SHARE STATISTICS", 0, ["Period", "Mar 2020", "Sep 2019"]), (1, "SHARE STATISTICS", 1, ["12 Month HEPS", "1", "2"]), (1, "SHARE STATISTICS", 2, ["12 Month HEPS (again)", "3"])]
    found = html.share_statistics(pages, table_id="fin_S").collect()
    assert sorted((r["page_id"], r["results_period_label"], r["heps_12m_zarc"]) for r in found) == [(1, "Mar 2020", 3.0), (1, "Sep 2019", 2.0)]
    assert html.ratios(pages, table_id="fin_R").count() == 0


ODD = [
    LOOSE, "", "<p>none", "<table id=fin_S>", "<table id=fin_S></table>", "<table id=fin_S><td>no row<tr><td>a</table>", "<table id=fin_S><tr><td>a</tr><td>b</table>", "<table id=fin_S><tr><td>a</th>b<td>c</table>",
    "<tr><table id=fin_S><tr></tr></tr><tr><td>a</table>", "<div><table id=fin_S><tr><td>a</div><tr><td>b</table>", "<table><tr><td><table id=fin_S><tr><td>in</table></table>", "<table id=fin_S><tr><td>a<table id=fin_R><tr><td>b</table><td>c</table>",
    "<table id=fin_S><tbody><tr><td>a</tbody></table>", "<table id=fin_S><tr><td>a &amp; <b> b&nbsp;<i>c</i></b>\n<br> d </td>lost</tr>\n</table>", "<table id=fin_S><tr><td><p>a<p>b</p></p>c<td>d</table>", "<table id=fin_S><tr><td>a<b>c</i></b><td>d</table>",
    "<!-- <table id=fin_S><tr><td>x</table> --><table id=fin_S><tr><td>y</table>", "<script>'<table id=fin_S>'</script><title><</title><table id=fin_S><tr><td>y</table>", "<title>a &lt;</title><script>var a='<table id=fin_S><tr><td>x</table>'</script><table id=fin_S><tr><td>y</table>",
    "<ul><li><table id=fin_S><tr><td>a<li>b<td>c</table>", "<TABLE id=fin_S><TR><TD>a</TABLE>", '<table class="x > y" id=\'fin_S\'><tr a=1><td title="a>b">a</table>', "<table id=fin_R id=fin_S><tr><td>a\nb<th> c </th><td/></table>", "<table id=fin_S><tr><b>x<td>a</b><td>b</table>", "<table id=fin_S><tr><td>&bogus;&copy &lt;td&gt;</table>",
]


def _by_tree(page, ids):
    found = {}
    for table in html.Tree(page).root.all("table"):
        if table.attrs.get("id") in ids:
            found.setdefault(table.attrs["id"], html.cells(table))
    return found


def test_grids_are_those_of_the_tree():
    for page in ODD:
        assert list(html.grids(page, html.FINANCIALS).items()) == list(_by_tree(page, html.FINANCIALS).items()), page
    draw = random.Random(7)
    for _ in range(3000):
        inner = "".join(draw.choice(["<tr>", "<tr>", "<td>", "<td>", "<th>", "</td>", "</tr>", "<b>", "</b>", "<p>", "</p>", "<br>", "x", " y ", "&amp;", "\n", "</th>", "<li>", "</div>", "<tbody>", "<!--c-->"]) for _ in range(draw.randrange(14)))
        page = draw.choice(["", "<div>", "<li>", "<tr>"]) + "<table id=fin_S><tr>" + inner + draw.choice(["</table>", "</table><table id=fin_R><tr><td>z</table>", ""])
        assert html.grids(page, html.FINANCIALS) == _by_tree(page, html.FINANCIALS), page


def test_plain_tables_are_read_without_a_tree(spark, monkeypatch):
    pages = [r["html"] for r in reports._company_pages(spark, "/root/testdata/sf0.001").limit(20).collect()]
    wanted = [_by_tree(p, html.FINANCIALS) for p in pages]
    monkeypatch.setattr(html, "Tree", None)
    assert [html.grids(p, html.FINANCIALS) for p in pages] == wanted and all(len(w) >= 4 for w in wanted)


def test_company_tables_makes_no_rows_that_it_drops(spark):
    plan = reports.company_tables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "SHARE STATISTICS" not in plan and "Filter" not in plan


def test_ends_of_periods_are_worked_out_once(spark):
    page = "<table id=fin_R><tr><td>Period<th>Mar 2020<th>some day 2020<th>Sep 2019<tr><td>Quick Ratio<td>−1 000.5<td>7<td>N/A</table>"
    found = html.ratios(spark.createDataFrame([(1, page)], "page_id int, html string"), table_id="fin_R")
    assert [(str(r["results_period_end"]), r["quick_ratio"]) for r in found.collect()] == [("2020-03-31", -1000.5), ("2019-09-30", None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_to_timestamp") == 1 and plan.count("translate(") == 1


def test_numbers_and_placeholders(spark):
    texts = ["-", "—", "N/A", "", " ", " 1 234.5 ", "−7", "1,5", "x", "- 3", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.number(F.col("t")).alias("n")).orderBy("i")
    assert [r["n"] for r in df.collect()] == [None, None, None, None, None, 1234.5, -7.0, None, None, -3.0, None]
