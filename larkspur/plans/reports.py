"""Queries over pages that show rows of given tables: what is read back must be those rows.

A page shows up to eight orders, ten parts or sixteen events, with numbers and dates as sites
write them, cells that are missing, rows that correct earlier ones, and tables that are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.registry import AS_OF, query
from larkspur.sources import html as H
from larkspur.sources import table


def _shown(c: str) -> str:
    """A number with a no-break space between thousands and a minus sign of its own; a dash for none."""
    return f"coalesce(replace(replace(format_number({c}, '0,000.00'), ',', chr(160)), '-', '\\u2212'), '-')"


#: The cells of an order.
_CELLS = {
    "label": "concat('<th> ', date_format(o_orderdate, 'MMM yyyy'), ' (12m)', CASE WHEN id % 3 <> 0 THEN date_format(o_orderdate, ' d MMM yyyy') ELSE '' END, ' ')",
    "cash": "concat('<td>', id)", "v": "concat('<td>', v)", "bold": "concat('<td><b>', v, '</b>')", "one": "'<td>1'",
    "heps": f"concat('<td>', {_shown('CASE WHEN id % 5 <> 0 THEN v / 4 END')})", "dividend": f"concat('<td>', {_shown('CASE WHEN id % 7 <> 0 THEN -v / 2 END')})",
    "nav": f"concat('<td>', {_shown('CAST(v * 2 AS DOUBLE)')})", "restated": f"concat('<td>', {_shown('v * 3 / 4')})", "quick": f"concat('<td>', {_shown('o_custkey / 4')})",
}


def _company_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(page, html): five tables of each eight orders; every fourth page has no cash flow, every third a title above its statistics.

    Orders are dealt by their page before their cells are written: numbers are moved, not texts.
    """
    id = F.col("o_orderkey")  # noqa: A001
    o = table(spark, sf, "orders").select(id.alias("id"), F.floor(id / 8).cast("long").alias("page"), F.floor("o_totalprice").cast("long").alias("v"), "o_orderdate", "o_custkey").repartition("page")
    pages = o.select("id", "page", *(F.expr(e).alias(c) for c, e in _CELLS.items())).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", *_CELLS))).alias("x"))

    def row(label: str, cell: str, cells: str = "x") -> str:
        return f"concat('<tr><td>{label}', array_join({cells}.{cell}, ''), '</tr>')"

    head = row("Period", "label")
    with_means = head.replace("'</tr>'", "'<th>Avg. 5y 2020<th>3y Growth 2020</tr>'")
    title = "CASE WHEN page % 3 = 0 THEN '<tr><th>Statistics<th>in cents</tr>' ELSE '<tr><th>Statistics</tr>' END"
    parts = [
        "'<html><body><table><tr><td>12 Month HEPS<td>1</table><table id=fin_I>'", head, row("Revenue", "v"), "'</table><table id=fin_B>'", row("Assets &amp; more", "bold"), "'</table>'",
        f"CASE WHEN page % 4 <> 0 THEN concat('<table id=fin_C>', {row('Cash', 'cash')}, '</table>') ELSE '' END",
        "'<table id=fin_S>'", title, with_means, row("12 Month HEPS (c)", "heps"), row("12 month dividend", "dividend"), row("NET ASSET VALUE per share (ZARc) *", "nav"),
        row("12 Month HEPS restated", "restated", "slice(x, 1, CAST(page % 3 AS INT))"), "'</table><table id=fin_R>'", with_means, row("Current Ratio", "v"), row("Quick Ratio", "quick"), row("Quick Ratio (group)", "one"), "'</table><table id=fin_S><tr><td>second</table></body></html>'",
    ]
    return pages.select("page", F.concat(*(F.expr(p) for p in parts)).alias("html"))


_ORDERS = "(SELECT *, floor(o_totalprice)::BIGINT AS v, o_orderkey // 8 AS page, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) AS i FROM orders)"
_LABEL = "strftime(o_orderdate, '%b %Y') || ' (12m)' || CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, ' %-d %b %Y') ELSE '' END"


@query(f"""SELECT page, last_day(o_orderdate) AS results_period_end, {_LABEL} AS results_period_label, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS results_release_date,
  CASE WHEN i <= page % 3 THEN v * 3 / 4.0::DOUBLE WHEN o_orderkey % 5 <> 0 THEN v / 4.0::DOUBLE END AS heps_12m_zarc, CASE WHEN o_orderkey % 7 <> 0 THEN -v / 2.0::DOUBLE END AS dividend_12m_zarc, NULL::DOUBLE AS cash_gen_ps_zarc, v * 2.0::DOUBLE AS nav_ps_zarc FROM {_ORDERS}""")
def company_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Results by period: a restated row that is shorter changes the first periods alone."""
    return H.share_statistics(_company_pages(spark, sf), keep=("page",), table_id="fin_S")


@query(f"SELECT page, last_day(o_orderdate) AS results_period_end, o_custkey / 4.0::DOUBLE AS quick_ratio FROM {_ORDERS}")
def company_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of the ratio by period."""
    return H.ratios(_company_pages(spark, sf), keep=("page",), table_id="fin_R")


@query(f"""SELECT page, 'INCOME STATEMENT' AS name, 0 AS row_no, 'Period|' || string_agg({_LABEL}, '|' ORDER BY i) AS line FROM {_ORDERS} GROUP BY page UNION ALL SELECT page, 'INCOME STATEMENT', 1, 'Revenue|' || string_agg(v, '|' ORDER BY i) FROM {_ORDERS} GROUP BY page
UNION ALL SELECT page, 'BALANCE SHEET', 0, 'Assets & more|' || string_agg(v, '|' ORDER BY i) FROM {_ORDERS} GROUP BY page UNION ALL SELECT page, 'CASH FLOW', 0, 'Cash|' || string_agg(o_orderkey, '|' ORDER BY i) FROM {_ORDERS} WHERE page % 4 <> 0 GROUP BY page""")
def company_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the named tables of each page, here of those that show no statistics."""
    shown = {id: name for id, name in H.FINANCIALS.items() if name not in ("SHARE STATISTICS", "RATIOS")}  # noqa: A001
    return H.named_tables(_company_pages(spark, sf), shown, keep=("page",)).select("page", "name", "row_no", F.array_join("row", "|").alias("line"))


def _joined(rows: DataFrame, page: Column, order: str, cell: Column) -> DataFrame:
    """(page, html): the cells of each page in order."""
    return rows.groupBy(page.cast("long").alias("page")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), cell.alias("c")))).alias("x")).select("page", F.concat(F.lit("<html><body><ul><table>"), F.array_join("x.c", "\n"), F.lit("</table></ul></body></html>")).alias("html"))


@query("""SELECT p_partkey // 10 AS page, CASE p_partkey % 10 WHEN 1 THEN 'gold' WHEN 4 THEN 'silver' WHEN 8 THEN 'USDZAR' END AS symbol, floor(p_retailprice * 100)::BIGINT / 4.0::DOUBLE AS price,
  CASE p_partkey % 3 WHEN 0 THEN TIMESTAMP '2024-01-31' + to_minutes(p_size) WHEN 1 THEN TIMESTAMP '2024-01-01' + to_days(p_partkey::INT % 28) END AS as_of_ts FROM part WHERE p_partkey % 10 IN (1, 4, 8) AND p_partkey % 7 <> 0""")
def part_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of the wanted symbols as quotes: today's by the clock, this year's by the day, some without a time; rows without a price go."""
    k, price = F.col("p_partkey"), F.format_number(F.floor(F.col("p_retailprice") * 100).cast("long") / 4, 2)
    clock = F.format_string("%02d:%02d", F.floor(F.col("p_size") / 60).cast("int"), (F.col("p_size") % 60).cast("int"))
    day = F.date_format(F.expr("date_add(DATE '2024-01-01', CAST(p_partkey % 28 AS INT))"), "MMM/dd")
    when = F.when(k % 3 == 0, clock).when(k % 3 == 1, day).otherwise("a while ago")
    cell = F.concat(F.lit('<tr data-symbol="C'), (k % 10).cast("string"), F.lit('"><td>x'), F.when(k % 7 != 0, F.concat(F.lit('<td id="p"> '), price)).otherwise(""), F.lit('<td id="date">'), when, F.lit("</tr>"))
    found = H.quotes(_joined(table(spark, sf, "part"), F.floor(k / 10), "p_partkey", cell), {"gold": "C1", "silver": "C4", "USDZAR": "C8"}, AS_OF, keep=("page",))
    return found.withColumn("as_of_ts", F.col("as_of_ts").cast("timestamp_ntz"))


@query("""SELECT e.event_id // 16 AS page, date_trunc('minute', e.ts) AS published, e.event_type || ' & ' || e.user_id AS headline, '/n?id=' || e.event_id AS href FROM events e LEFT JOIN events c ON c.event_id = e.event_id // 16 * 16 + 3
WHERE e.event_id % 5 <> 0 AND (c.event_id IS NULL OR date_trunc('minute', e.ts) > date_trunc('minute', c.ts))""")
def event_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """News later than what is known of each page, not news of that minute; rows without a readable date are left out."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    shown = F.when(k % 5 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "dd MMM yyyy HH:mm"))
    cell = F.concat(F.lit("<li><span>"), shown, F.lit('</span><a href="/n?id='), k.cast("string"), F.lit('"><i>'), F.col("event_type"), F.lit("</i> &amp; "), F.col("user_id").cast("string"), F.lit("</a>"))
    found = H.headlines(_joined(e, F.floor(k / 16), "event_id", cell), keep=("page",))
    known = e.where("event_id % 16 = 3").select(F.floor(k / 16).cast("long").alias("page"), F.date_trunc("minute", "ts").alias("cutoff"))
    late = found.withColumn("published", F.col("published").cast("timestamp_ntz")).join(known, "page", "left")
    return late.where("cutoff IS NULL OR published > cutoff").drop("cutoff")
