"""Queries over pages: tables of results, ratios, quotes, headlines, documents; and analyses of what was found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.functions import text as T
from larkspur.operators import text as OT
from larkspur.plans.lists import ENTRIES
from larkspur.plans.registry import AS_OF, query, relation
from larkspur.plans.texts import CATEGORIES, FALLBACK, TEMPLATES
from larkspur.sources import html as H
from larkspur.sources import spread, table, watchlist

#: A page for each customer: two tables of results, a list of quotes and one of news, a link to a document.
PAGES = """SELECT c_custkey AS key, '<html><body><table id="fin_S"><tr><th>Results<th>Mar 2020 (12m) 5 Apr 2020</th><th>Avg. 5y</th><th>Sep 2019</th></tr><tr><td>12 Month HEPS (c)</td><td> ' || c_custkey || '.5</td><td>1</td><td>-</td></tr>'
    || '<tr><td>Net Asset Value Per Share (ZARc)</td><td>1 ' || (c_custkey + 100) || '</td><td>2</td><td>' || c_nationkey || '</td></tr></table>'
    || '<table id="fin_R"><tr><td>Ratio</td><td>Mar 2020</td></tr><tr><td>Quick Ratio</td><td>' || c_nationkey || '.25</td></tr><tr><td>quick ratio again</td><td>9</td></tr></table>'
    || '<table><tr data-symbol="XAU"><td id="p">1,' || (c_custkey % 900 + 100) || '.5</td><td id="date">12:30</td></tr><tr data-symbol="XAG"><td id="date">Dec/18</td></tr></table>'
    || '<ul><li><span>09 Dec 2025 17:05</span><a href="/n?id=' || c_custkey || '">News <b>of</b> it</a></li><li><span>soon</span><a href="/x">no date</a></li></ul>'
    || '<div id="sens-content"><p>First</p><p>line ' || c_custkey || '</p></div><a href="/files/' || c_custkey || '.pdf">report</a>' || CASE WHEN c_custkey % 2 = 0 THEN '<table><tr><td><a href="/best.pdf">x</a></td></tr></table>' ELSE '' END || '</body></html>' AS html,
  c_nationkey AS nation FROM {customer}"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, PAGES, customer=spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey"))


@query("SELECT key, DATE '2020-03-31' AS results_period_end, 'Mar 2020 (12m) 5 Apr 2020' AS results_period_label, DATE '2020-04-05' AS results_release_date, key + 0.5::DOUBLE AS heps_12m_zarc, NULL::DOUBLE AS dividend_12m_zarc, NULL::DOUBLE AS cash_gen_ps_zarc, ('1' || (key + 100))::DOUBLE AS nav_ps_zarc FROM pages_ UNION ALL SELECT key, DATE '2019-09-30', 'Sep 2019', NULL, NULL, NULL, NULL, nation::DOUBLE FROM pages_", pages_=PAGES)
def share_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Results by period out of the first table of each page."""
    first = pages(spark, sf).withColumn("html", F.regexp_extract("html", r"(?s)<table id=.fin_S.>.*?</table>", 0))
    return H.share_statistics(first, keep=("key",))


@query("SELECT key, DATE '2020-03-31' AS results_period_end, nation + 0.25::DOUBLE AS quick_ratio FROM pages_", pages_=PAGES)
def ratio_tables(spark: SparkSession, sf: str) -> DataFrame:
    second = pages(spark, sf).withColumn("html", F.regexp_extract("html", r"(?s)<table id=.fin_R.>.*?</table>", 0))
    return H.ratios(second, keep=("key",))


@query("SELECT key, table_no::INT AS table_no, t.id AS table_id, n AS n_cells FROM pages_, (VALUES (0, 'fin_S', 12), (1, 'fin_R', 6), (2, NULL, 3), (3, NULL, 1)) t(table_no, id, n) WHERE table_no < 3 OR key % 2 = 0", pages_=PAGES)
def html_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of every table; here their number."""
    return H.tables(pages(spark, sf), keep=("key",)).groupBy("key", "table_no", "table_id").agg(F.count(F.lit(1)).cast("int").alias("n_cells"))


@query("SELECT key, 'gold' AS symbol, ('1' || (key % 900 + 100) || '.5')::DOUBLE AS price, TIMESTAMP '2024-01-31 12:30:00' AS as_of_ts FROM pages_", pages_=PAGES)
def page_quotes(spark: SparkSession, sf: str) -> DataFrame:
    found = H.quotes(pages(spark, sf), {"gold": "XAU", "silver": "XAG"}, AS_OF, keep=("key",))
    return found.withColumn("as_of_ts", F.col("as_of_ts").cast("timestamp_ntz"))


@query("SELECT key, TIMESTAMP '2025-12-09 17:05:00' AS published, 'News of it' AS headline, '/n?id=' || key AS href FROM pages_ WHERE key % 3 <> 0", pages_=PAGES)
def page_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """News later than each page's cutoff, without those that have no date."""
    found = H.headlines(pages(spark, sf), keep=("key",)).withColumn("published", F.col("published").cast("timestamp_ntz"))
    cutoff = F.when(F.col("key") % 3 == 0, F.lit("2025-12-09 17:05:00")).otherwise(F.lit("2025-12-09 17:04:00")).cast("timestamp_ntz")
    return found.where(F.col("published") > cutoff)


@query("SELECT key, CASE WHEN key % 2 = 0 THEN '/best.pdf' ELSE '/files/' || key || '.pdf' END AS href FROM pages_", pages_=PAGES)
def page_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The document of each page: a link in a table comes before any other."""
    return H.document_links(pages(spark, sf), keep=("key",)).select("key", "href")


@query("SELECT key, 'First' || chr(10) || 'line ' || key AS content FROM pages_", pages_=PAGES)
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return H.element_text(pages(spark, sf), "sens-content", keep=("key",))


@query("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id AND o_orderstatus = 'O')")
def new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that aren't there yet: one anti-join, not a probe for each."""
    seen = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf, "events").join(seen, "event_id", "left_anti").select("event_id")


_REPLY = "'# Analysis' || chr(10) || 'Significance: ' || CASE length(prompt) % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END || chr(10) || left(prompt, 80)"


@query(f"SELECT id, left(content, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END AS trigger_content, {_REPLY} AS ai_analysis, CASE length(prompt) % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS significance FROM (SELECT event_id AS id, event_type || ' ' || props AS content, name || ': ' || event_type || ' ' || props || chr(10) || 'Strategy: ' || status AS prompt FROM events JOIN watchlist ON user_id = key)")
def analysis_log(spark: SparkSession, sf: str) -> DataFrame:
    """What the analyzer says about each announcement of a listed key, and how much that matters."""
    context = watchlist(spark, sf).select("key", "name", F.col("status").alias("strategy"))
    news = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.concat_ws(" ", "event_type", "props").alias("content"))
    return OT.logged(news, context, "key").drop("key")


@query(f"SELECT event_type, {_REPLY} AS ai_analysis FROM (SELECT event_type, event_type || ': ' || count(*) || ' prices, mean ' || (sum(floor(value * 100)::BIGINT)::DOUBLE / count(*))::DECIMAL(18,4) AS prompt FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY event_type)")
def spot_context(spark: SparkSession, sf: str) -> DataFrame:
    """Averages as the context of a question for each symbol, and the analyzer's reply."""
    e = table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), X.dec(F.sum(F.floor(F.col("value") * 100).cast("long")).cast("double") / F.count(F.lit(1))).alias("mean"))
    asked = per.withColumn("prompt", T.filled("{t}: {n} prices, mean {mean}", t=F.col("event_type"), n=F.col("n"), mean=F.col("mean")))
    return OT.analysed(asked, "prompt", out="ai_analysis").select("event_type", "ai_analysis")


#: The template that each category gets.
GOLDEN = """SELECT * FROM (VALUES (1, 'commodity'), (2, 'sa_inc_mid_small'), (3, 'banks'), (4, 'REITS'), (5, 'holding_company'), (6, 'telecoms'), (7, 'insurance'), (8, 'logistics'), (9, 'construction'), (10, 'sa_inc_mid_small'), (11, 'healthcare'), (12, 'sa_inc_mid_small'), (13, 'sa_inc_mid_small'), (14, 'sa_inc_mid_small')) AS g(id, template)"""


@query("SELECT c_custkey AS key, category, template FROM customer JOIN categories c ON c.id = c_custkey % 14 + 1 JOIN golden g ON g.id = c.id", categories=CATEGORIES, golden=GOLDEN)
def template_match(spark: SparkSession, sf: str) -> DataFrame:
    """The template of each instrument's category: equal names, else one that holds the other, else the fallback."""
    return OT.matched(_categorised(spark, sf).select("key", "category"), "category", relation(spark, sf, TEMPLATES), "stem", FALLBACK)


def _categorised(spark: SparkSession, sf: str) -> DataFrame:
    rows = relation(spark, sf, ENTRIES).withColumn("id", (F.col("key") % 14 + 1).cast("int"))
    return rows.join(F.broadcast(relation(spark, sf, CATEGORIES)), "id").select("key", "name", "research", "category")


def _told(prompts: pd.Series) -> pd.Series:
    """Replies of every kind by the prompt's length: a report, one that is too short, a failure, one without headings."""
    kind = prompts.str.len() % 4
    long = prompts.str.repeat(40)
    return ("# Report\n" + long).where(kind == 0, prompts.where(kind == 1, ("Error: " + long).where(kind == 2, long.str.replace("#", "", regex=False).str.slice(0, 900))))


_REPORT = "'# Report' || chr(10) || repeat(prompt, 40)"


@query(
    f"""SELECT key, template, CASE WHEN length(prompt) % 4 = 0 THEN {_REPORT} END AS research, CASE length(prompt) % 4 WHEN 1 THEN 'short' WHEN 2 THEN 'failed' WHEN 3 THEN 'plain' END AS fault
FROM (SELECT key, template, 'Template ' || template || chr(10) || 'Company ' || name AS prompt FROM entries JOIN golden ON key % 14 + 1 = id WHERE coalesce(trim(research), '') = '')""",
    entries=ENTRIES, golden=GOLDEN,
)
def research_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without research get a template and a reply, and keep those that are reports."""
    return OT.researched(_categorised(spark, sf), "key", "research", relation(spark, sf, TEMPLATES), "stem", FALLBACK, _told)
