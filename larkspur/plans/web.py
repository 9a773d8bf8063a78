"""Queries over the pages as they are in the table: lists of links, heads, bodies, ways of finding an element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.registry import query
from larkspur.sources import html as H
from larkspur.sources import table

_ENTITIES = """replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')"""
_LINK = """'<li><a href="([^"]*)">([^<]*)</a></li>'"""


@query(f"""SELECT page_id, (i - 1)::INT AS row_no, {_ENTITIES.format("t")} AS title, {_ENTITIES.format("h")} AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(nav, {_LINK}, 1)) AS h, unnest(regexp_extract_all(nav, {_LINK}, 2)) AS t, generate_subscripts(regexp_extract_all(nav, {_LINK}, 1), 1) AS i
  FROM (SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') AS nav FROM pages)) WHERE trim(t) <> ''""")
def page_menus(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of each page's list of links, with what is in them."""
    found = H.listed(table(spark, sf, "pages"), ("table.list tr", "nav ul li"), {"title": "a", "href": "a@href"}, need=("title",))
    return found.select("page_id", "row_no", "title", "href")


@query(f"""SELECT page_id, 1 AS way, {_ENTITIES.format("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} AS title, {_ENTITIES.format("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")} AS headline, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def page_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Title, headline and language of each page, by the first way of finding its head that finds one."""
    found = H.listed(table(spark, sf, "pages"), ("#frame html", "html"), {"title": "head title", "headline": "article h1", "lang": "@lang"}, need=("title",))
    return found.select("page_id", "way", "title", "headline", "lang")


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_PIECES = f"list_filter(list_transform(string_split(regexp_replace({{}}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: {_TRIM.format(_ENTITIES.format('x'))}), lambda x: x <> '')"


@query(f"""SELECT page_id, 1 AS way, len(p)::INT AS pieces, sha256(array_to_string(p, chr(10))) AS digest FROM (SELECT page_id, {_PIECES.format("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS p FROM pages)""")
def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of each page's article, piece by piece."""
    found = H.texts(table(spark, sf, "pages"), ("#sens-content", "article", "body"))
    return found.select("page_id", "way", "pieces", F.sha2("content", 256).alias("digest"))


@query(f"""SELECT page_id, 2 AS way, {_TRIM.format(_ENTITIES.format("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"))} AS notice, {_ENTITIES.format("regexp_extract(html, '(?s)<nav>.*?href=.([^>]*).>', 1)")} AS first_link FROM pages""")
def page_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Ways of finding an element in order: the first that finds one on a page counts."""
    p = table(spark, sf, "pages")
    notice = H.texts(p, ("#notice", ".warning", "div.ad")).select("page_id", "way", F.col("content").alias("notice"))
    link = H.listed(p, (".files a", "nav a[href]", "a"), {"first_link": "@href"}).where("row_no = 0").select("page_id", "first_link")
    return notice.join(link, "page_id")
