"""Queries over texts: symbols, dates, numbers, footers, reports, addresses, names of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import text as OT
from larkspur.plans.lists import TICKERS
from larkspur.plans.registry import AS_OF, query, relation
from larkspur.sources import table


@query("SELECT key, regexp_replace(trim(ticker), '[.][jJ][oO]$', '') AS bare, CASE WHEN trim(ticker) = '' OR upper(trim(ticker)) LIKE '%.JO' THEN trim(ticker) ELSE trim(ticker) || '.JO' END AS market, replace(ticker, '.JO', '') AS plain FROM tickers", tickers=TICKERS)
def ticker_normalise(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ticker")
    return relation(spark, sf, TICKERS).select("key", T.bare_ticker(t).alias("bare"), T.market_ticker(t).alias("market"), T.without_suffix(t).alias("plain"))


_MONTH = "CASE CAST(month(o_orderdate) AS INT) WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'MAY' WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END"
#: Labels, headline times, quotes and numbers as pages show them, some of them unreadable.
LABELS = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'Avg. growth' ELSE {_MONTH} || ' ' || year(o_orderdate) || ' (12m) ' || CASE WHEN o_orderkey % 5 = 0 THEN '99 Foo 2020' ELSE day(o_orderdate) || ' Apr ' || year(o_orderdate) END END AS label,
  CASE WHEN o_orderkey % 7 = 0 THEN 'yesterday' WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) || '-' || {_MONTH} || '-' || year(o_orderdate) ELSE ' ' || day(o_orderdate) || ' ' || {_MONTH} || ' ' || year(o_orderdate) || ' 7:05 ' END AS headline,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '-' WHEN 1 THEN '1 2' || CAST(o_orderkey % 90 + 10 AS INT) || '.5' WHEN 2 THEN '1,234.' || CAST(o_orderkey % 90 + 10 AS INT) ELSE 'x' END AS amount,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN CAST(o_orderkey % 24 AS INT) || ':05' WHEN 1 THEN 'Dec/' || CAST(o_orderkey % 28 + 1 AS INT) WHEN 2 THEN '25:99' ELSE '' END AS quoted,
  '(' || CAST(o_orderkey % 30 AS INT) || CASE WHEN o_orderkey % 3 = 0 THEN '.25%) Entry' WHEN o_orderkey % 3 = 1 THEN ' %) Stop' ELSE ') none' END AS near,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '2024-01-02T03:04:05+02:00' WHEN 1 THEN NULL ELSE 'soon' END AS attribute, CASE WHEN o_orderkey % 2 = 0 THEN '31.01.24 09:30' ELSE 'n/a' END AS shown,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '2024-01-02 03:04:05.678' WHEN 1 THEN ' 2024-01-02T03:04:05Z' WHEN 2 THEN '2024-01-02 and more' ELSE 'never' END AS stamp FROM {{orders}}"""
_MON = "upper(left({0}, 1)) || lower(substr({0}, 2, 2))"


@query(
    f"""SELECT id, last_day(try_strptime('1 ' || {_MON.format("m")} || ' ' || y, '%d %b %Y'))::DATE AS period_end, try_strptime(rd || ' ' || {_MON.format("rm")} || ' ' || ry, '%d %b %Y')::DATE AS released FROM (
  SELECT id, regexp_extract(label, '^([A-Za-z]{{3}})[A-Za-z]*\\s*(\\d{{4}})', 1) AS m, regexp_extract(label, '^([A-Za-z]{{3}})[A-Za-z]*\\s*(\\d{{4}})', 2) AS y,
    regexp_extract(label, '(\\d{{1,2}})\\s+([A-Za-z]{{3}})\\s+(\\d{{4}})', 1) AS rd, regexp_extract(label, '(\\d{{1,2}})\\s+([A-Za-z]{{3}})\\s+(\\d{{4}})', 2) AS rm, regexp_extract(label, '(\\d{{1,2}})\\s+([A-Za-z]{{3}})\\s+(\\d{{4}})', 3) AS ry FROM labels)""",
    labels=LABELS,
)
def parse_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of periods and release dates in the headers of columns."""
    from larkspur import functions as X

    return relation(spark, sf, LABELS).select("id", X.period_end(F.col("label")).alias("period_end"), T.release_date(F.col("label")).alias("released"))


@query("SELECT id, CASE WHEN amount <> '-' THEN try_cast(replace(amount, ' ', '') AS DOUBLE) END AS financial, try_cast(replace(replace(trim(amount), ',', ''), ' ', 'x') AS DOUBLE) AS quoted, coalesce(try_cast(nullif(regexp_extract(near, '\\(?\\s*([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), '') AS DOUBLE), -1) AS near FROM labels", labels=LABELS)
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts without and with commas, and the percentage of a status (-1 for its infinity)."""
    from larkspur import functions as X

    near = T.percent_key(F.col("near"))
    return relation(spark, sf, LABELS).select("id", X.number(F.col("amount")).alias("financial"), T.quote_number(F.col("amount")).alias("quoted"), F.when(near == float("inf"), -1.0).otherwise(near).alias("near"))


@query(
    f"""SELECT id, CASE WHEN headline <> 'yesterday' THEN try_strptime(regexp_replace(trim(headline), '^(\\d+)[- ]([A-Za-z]{{3}})[a-z]*[- ](\\d+).*$', '\\1 \\2 \\3'), '%d %b %Y') + CASE WHEN id % 2 = 0 THEN INTERVAL 0 MINUTE ELSE INTERVAL 425 MINUTE END END AS headline,
  coalesce(CASE WHEN attribute LIKE '2024%' THEN TIMESTAMP '2024-01-02 03:04:05' END, CASE WHEN shown LIKE '31%' THEN TIMESTAMP '2024-01-31 09:30:00' END) AS announced,
  CASE WHEN id % 4 IN (0, 1) THEN TIMESTAMP '2024-01-02 03:04:05' WHEN id % 4 = 2 THEN TIMESTAMP '2024-01-02' END AS stamp,
  CASE id % 4 WHEN 0 THEN TIMESTAMP '2024-01-31 00:05:00' + to_hours((id % 24)::BIGINT) WHEN 1 THEN TIMESTAMP '2024-12-01' + to_days((id % 28)::INT) END AS quoted FROM labels""",
    labels=LABELS,
)
def parse_times(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines, announcements, stored stamps and quotes; times without a zone."""
    plain = lambda c: c.cast("timestamp_ntz")
    t = relation(spark, sf, LABELS)
    return t.select("id", plain(T.headline_time(F.col("headline"))).alias("headline"), plain(T.announcement_time(F.col("attribute"), F.col("shown"))).alias("announced"), plain(T.any_time(F.col("stamp"))).alias("stamp"), plain(T.quote_time(F.col("quoted"), AS_OF)).alias("quoted"))


NEWS = "SELECT event_id AS id, user_id AS key, CAST(ts AS DATE) AS published, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM {events}"


@query("SELECT n.id, n.key FROM news n LEFT JOIN (SELECT user_id AS key, max(ts)::DATE AS cut FROM events WHERE event_type = 'purchase' GROUP BY user_id) c ON n.key = c.key WHERE n.value IS NOT NULL AND (cut IS NULL OR n.published > cut)", news=NEWS)
def news_after_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines later than the last results of their key, without those that have no date."""
    cut = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").cast("date").alias("cut"))
    n = relation(spark, sf, NEWS).where("value IS NOT NULL").join(cut, "key", "left")
    return n.where(F.col("cut").isNull() | (F.col("published") > F.col("cut"))).select("id", "key")


#: Announcements with a footer in some: conversations with lines about their producer.
SENS = "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN text || CHR(10) || '  Produced by the JSE SENS Department ' || CHR(10) || 'more' WHEN turn % 3 = 1 THEN '' ELSE text || '  ' || CHR(10) END AS text FROM {conversations}"


@query(
    r"""SELECT id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS text FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n[^\n]*Produced by the JSE SENS(.|\n)*$', ''), '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), '^\n+|\n+$', '', 'g') AS t FROM sens)""",
    sens=SENS,
)
def footer_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Texts up to the line that names their producer, with tidy line ends."""
    return relation(spark, sf, SENS).select("id", T.cut_at_producer(F.col("text")).alias("text"))


#: Announcements that end in every way: named producers, sponsors' blocks, dates, and what only looks like one.
FOOTERS = """SELECT conv_id * 1000 + turn AS id, CASE CAST((conv_id + turn) % 8 AS INT) WHEN 0 THEN text || CHR(10) || 'Produced by the JSE SENS Department' || CHR(10) || 'more' WHEN 1 THEN ''
  WHEN 2 THEN text || CHR(10) || 'Sponsor' || CHR(10) || CHR(10) || 'A Bank' || CHR(10) || 'Street' || CHR(10) || CHR(10) || 'The SENS service' WHEN 3 THEN 'Sponsor: B' || CHR(10) || text || CHR(10) || 'c' || CHR(10) || 'd' || CHR(10) || 'Date: 1-2-24 ' || CHR(13) || CHR(10) || 'end'
  WHEN 4 THEN text || CHR(10) || 'sponcor' || CHR(10) || 'A' || CHR(10) || 'B' || CHR(10) || 'C' || CHR(10) || 'the JSE does' || CHR(10) || 'not' WHEN 5 THEN 'Date: 1/2/2024' || CHR(10) || text || CHR(10) || CHR(10) || CHR(10) || CHR(10) || CHR(10) || 'x'
  WHEN 6 THEN text || CHR(10) || 'Sponsor' || CHR(10) || CHR(10) || CHR(10) ELSE text END AS text FROM {conversations}"""
_TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), '^\\n+|\\n+$', '', 'g')"
_HITS = "list_transform(lines, lambda x: regexp_matches(x, '{}', 'i'))"
_END = "(?im)produced\\s+by\\b|\\bthe\\s+sens\\s+service\\b|\\bthe\\s+jse\\s+does\\s+not\\b|^\\s*date\\s*:"


@query(
    f"""SELECT id, CASE WHEN reason IN ('empty', 'no_change') THEN tidy WHEN t = '' THEN '' ELSE t || chr(10) END AS text, reason, length(tidy) AS original_chars, length(CASE WHEN reason IN ('empty', 'no_change') THEN tidy WHEN t = '' THEN '' ELSE t || chr(10) END) AS trimmed_chars
FROM (SELECT *, {_TIDY.format("array_to_string(lines[1:keep], chr(10))")} AS t FROM (SELECT *, CASE WHEN tidy = '' THEN 'empty' WHEN p > 0 THEN 'cut_at_produced_by' WHEN s > 0 AND s - 1 >= floor(0.6 * n) AND regexp_matches(array_to_string(lines[stop + 1:], chr(10)), '{_END}') THEN 'cut_after_sponsor_block'
  WHEN d > 0 AND d - 1 >= floor(0.7 * n) THEN 'cut_at_date_line' ELSE 'no_change' END AS reason, CASE reason WHEN 'cut_at_produced_by' THEN p - 1 WHEN 'cut_after_sponsor_block' THEN stop WHEN 'cut_at_date_line' THEN d - 1 ELSE n END AS keep
FROM (SELECT *, s + gap + coalesce(list_position(list_transform(lines[s + gap + 1:s + gap + 3], lambda x: x = ''), true) - 1, len(lines[s + gap + 1:s + gap + 3])) AS stop
FROM (SELECT *, coalesce(list_position(list_transform(lines[s + 1:], lambda x: x <> ''), true) - 1, n - s) AS gap
FROM (SELECT id, lines, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS tidy, len(lines) AS n, coalesce(list_position({_HITS.format("produced\\s+by\\b.*\\bsens\\b")}, true), 0) AS p,
  coalesce(list_max(list_transform(lines, lambda x, i: CASE WHEN regexp_matches(x, '\\bspon(?:s|c)or\\b', 'i') THEN i ELSE 0 END)), 0) AS s, coalesce(list_max(list_transform(lines, lambda x, i: CASE WHEN regexp_matches(x, '^\\s*date\\s*:\\s*\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{2,4}}', 'i') THEN i ELSE 0 END)), 0) AS d
FROM (SELECT id, t, string_split(t, chr(10)) AS lines FROM (SELECT id, {_TIDY.format("text")} AS t FROM footers)))))))""",
    footers=FOOTERS,
)
def footer_trim(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cascade with its reason and sizes."""
    return OT.trimmed(relation(spark, sf, FOOTERS), "id", "text")


#: What an analysis may say of its weight, after any text: in several forms, and in one that doesn't count.
WEIGHTS = """SELECT conv_id, turn, text || CASE CAST(turn % 4 AS INT) WHEN 0 THEN ' Significance: ' || w WHEN 1 THEN CHR(10) || 'SIGNIFICANCE - ' || upper(w) || ', more' WHEN 2 THEN ' significance ' || w || ' significance: low' ELSE ' significance of ' || w END AS t
  FROM (SELECT *, CASE CAST(length(text) % 3 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS w FROM {conversations})"""


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'significance\\W+(low|medium|high)', 'i') THEN upper(left(v, 1)) || lower(substr(v, 2)) END AS significance FROM (SELECT *, regexp_extract(t, 'significance\\W+(low|medium|high)', 1, 'i') AS v FROM weights)", weights=WEIGHTS)
def significance(spark: SparkSession, sf: str) -> DataFrame:
    """The weight that a text names first, with a capital."""
    from larkspur import functions as X

    return relation(spark, sf, WEIGHTS).select("conv_id", "turn", X.significance(F.col("t")).alias("significance"))


#: Names of categories and of the templates that exist for them.
CATEGORIES = """SELECT * FROM (VALUES (1, 'Mining & Commodities'), (2, 'General Retail'), (3, 'Banks & Financial Services'), (4, 'Property / REITs'), (5, 'Investment Holding Companies'), (6, 'Telecommunications'), (7, 'Insurance (Life & General)'),
  (8, 'Logistics & Transport'), (9, 'Construction & Materials'), (10, 'Small/Mid-Cap Industrials'), (11, 'Healthcare & Hospitals'), (12, 'Agriculture & Poultry'), (13, 'AltX / Speculative / Penny Stocks'), (14, NULL)) AS c(id, category)"""
TEMPLATES = "SELECT * FROM (VALUES ('REITS'), ('agriculture_poultry'), ('banks'), ('clothing_food_furniture'), ('commodity'), ('construction'), ('healthcare'), ('holding_company'), ('insurance'), ('logistics'), ('sa_inc_mid_small'), ('speculative_illiquid'), ('telecoms')) AS t(stem)"
FALLBACK = "sa_inc_mid_small"


@query("SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 500 THEN 'short' WHEN starts_with(lower(t), 'sorry') OR starts_with(lower(t), 'error') THEN 'failed' WHEN NOT contains(t, '#') AND length(t) < 2000 THEN 'plain' END AS fault FROM (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN 'Sorry, ' || coalesce(text, '') WHEN doc_id % 11 = 0 THEN ' # ' || coalesce(text, '') ELSE coalesce(text, '') END, '^[ \\t\\n\\v\\f\\r]+', ''), '[ \\t\\n\\v\\f\\r]+$', '') AS t FROM documents)")
def reports_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Which replies aren't reports, and why."""
    id = F.col("doc_id")  # noqa: A001
    plain = F.coalesce("text", F.lit(""))
    t = F.when(id % 7 == 0, F.concat(F.lit("Sorry, "), plain)).when(id % 11 == 0, F.concat(F.lit(" # "), plain)).otherwise(plain)
    return table(spark, sf, "documents").select("doc_id", T.report_fault(t).alias("fault"))


@query("SELECT key, 'Stock ' || name || ' at ' || price_c || ' cents' || chr(10) || 'Notes: ' || coalesce(CASE WHEN key % 3 = 0 THEN status END, '') AS prompt FROM watchlist")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A template filled with each row's values; missing ones are empty."""
    from larkspur.sources import watchlist

    text = T.filled("Stock {name} at {price} cents\nNotes: {notes}", name=F.col("name"), price=F.col("price_c"), notes=F.when(F.col("key") % 3 == 0, F.col("status")))
    return watchlist(spark, sf).select("key", text.alias("prompt"))


#: Links as pages have them: relative, absolute, with dots, backslashes or scripts.
LINKS = """SELECT page_id, url, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN '../a/./b.pdf?x=1#y' WHEN 1 THEN '/PDF/c.pdf' WHEN 2 THEN 'https://h.example/ost/PDF/d.pdf' WHEN 3 THEN 'javascript:void(0)' WHEN 4 THEN '..' || CHR(92) || '..' || CHR(92) || 'e.pdf' WHEN 5 THEN '' WHEN 6 THEN 'folder/' ELSE 'f.html?id=' || page_id || '&z=2' END AS href,
  CASE WHEN page_id % 3 = 0 THEN 'window.open( ''/w/g.pdf'', 1)' END AS onclick, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'attachment; filename="n 1.pdf"; x' WHEN 1 THEN 'filename=n2.pdf' END AS disposition FROM {pages}"""


def absolute(link: str, page: str) -> str:
    """SQL of a link as seen from a page: segments are folded from the left."""
    start = "'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)'"
    site, folder = f"regexp_extract({page}, {start}, 1)", f"regexp_replace(regexp_extract({page}, {start}, 2), '[^/]*$', '')"
    value = f"trim(replace({link}, chr(92), '/'))"
    whole = f"CASE WHEN regexp_matches({value}, '(?i)^https?://') THEN {value} WHEN starts_with({value}, '//') THEN regexp_extract({page}, '^[A-Za-z][A-Za-z0-9+.-]*:') || {value} WHEN starts_with({value}, '/') THEN {site} || {value} ELSE {site} || coalesce(nullif({folder}, ''), '/') || {value} END"
    parts = f"(SELECT [regexp_extract(u, {start}, 1), regexp_extract(u, {start}, 2), regexp_replace(u, {start}, '')] FROM (SELECT {whole} AS u))"
    kept = "list_reduce(list_prepend('', list_filter(string_split(p[2], '/'), lambda s: s NOT IN ('', '.'))), lambda a, s: CASE WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)"
    return f"CASE WHEN {value} <> '' THEN (SELECT p[1] || CASE WHEN k = '' THEN '/' ELSE k || CASE WHEN p[2] LIKE '%/' THEN '/' ELSE '' END END || p[3] FROM (SELECT p, {kept} AS k FROM (SELECT {parts} AS p))) END"


_TARGET = "CASE WHEN page_id % 8 IN (3, 5) THEN CASE WHEN page_id % 3 = 0 THEN '/w/g.pdf' END ELSE href END"


@query(
    f"""SELECT page_id, absolute, nullif(regexp_extract(absolute, '[?&]id=([^&#]*)', 1), '') AS article, name,
  CASE WHEN absolute IS NULL THEN '' WHEN regexp_matches(absolute, '^[a-z]+://[^/?#]*/PDF/') THEN concat_ws(' ', absolute, replace(absolute, '/PDF/', '/ost/PDF/'), replace(absolute, '/PDF/', '/ost/sp/profilem/PDF/')) WHEN regexp_matches(absolute, '^[a-z]+://[^/?#]*/ost/PDF/') THEN concat_ws(' ', absolute, replace(absolute, '/ost/PDF/', '/ost/sp/profilem/PDF/')) ELSE absolute END AS places
FROM (SELECT page_id, absolute, coalesce(CASE page_id % 4 WHEN 0 THEN 'n 1.pdf' WHEN 1 THEN 'n2.pdf' END, nullif(regexp_extract(absolute, '([^/?#]*)([?#].*)?$', 1), ''), 'download.pdf') AS name
FROM (SELECT page_id, {absolute("t", "'http://site.example/x/y/page.aspx?q=1'")} AS absolute FROM (SELECT page_id, {_TARGET} AS t FROM links)))""",
    links=LINKS,
)
def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute addresses, ids, other places and names of the links; tested against the standard library."""
    base = F.lit("http://site.example/x/y/page.aspx?q=1")
    t = relation(spark, sf, LINKS).withColumn("absolute", T.absolute_url(base, T.anchor_target(F.col("href"), F.lit(None).cast("string"), F.col("onclick"))))
    return t.select("page_id", "absolute", T.query_value(F.col("absolute"), "id").alias("article"), F.array_join(T.other_places(F.col("absolute")), " ").alias("places"), T.download_name(F.col("disposition"), F.col("absolute")).alias("name"))


@query("SELECT page_id, CASE WHEN page_id % 8 IN (3, 5) THEN CASE WHEN page_id % 3 = 0 THEN '/w/g.pdf' END ELSE href END AS target, coalesce(CASE page_id % 4 WHEN 0 THEN 'n 1.pdf' WHEN 1 THEN 'n2.pdf' END, nullif(regexp_extract(href, '([^/?#]*)([?#].*)?$', 1), ''), 'download.pdf') AS name FROM links", links=LINKS)
def anchor_targets(spark: SparkSession, sf: str) -> DataFrame:
    target = T.anchor_target(F.col("href"), F.lit(None).cast("string"), F.col("onclick"))
    return relation(spark, sf, LINKS).select("page_id", target.alias("target"), T.download_name(F.col("disposition"), F.col("href")).alias("name"))


@query("SELECT event_id, 'news_' || strftime(ts, '%Y-%m-%d_%H%M') || '_' || CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE '' END || '_' || event_type || '_' || user_id AS name, strftime(ts, '%Y%m%d') || '.pdf' AS dated FROM events")
def artifact_names(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat_ws(" / ", F.col("event_type"), F.col("user_id").cast("string"))
    article = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", T.artifact_name(F.col("ts"), article, title).alias("name"), T.dated_name(F.col("ts")).alias("dated"))


@query("SELECT p_partkey, CASE WHEN length(s) <= 12 THEN s ELSE 'file-' || left(sha1(p_name), 12) END AS name FROM (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def short_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.resource_name(F.col("p_name"), 12).alias("name"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'premium' WHEN page_id % 5 = 1 THEN 'terms' WHEN page_id % 5 = 2 THEN 'anonymous' WHEN page_id % 5 = 3 THEN 'concurrent' END AS issue, CASE WHEN page_id % 2 = 0 THEN 'SENS_20240131_a' || page_id || '.pdf' END AS document FROM pages""")
def page_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Why pages weren't shown, and the documents that they name."""
    k = F.col("page_id") % 5
    says = F.when(k == 0, "You need a PREMIUM subscription").when(k == 1, "You have not accepted the Terms of Use or Conditions of Subscription").when(k == 2, "You need to be logged on as a free registered user").when(k == 3, "Concurrent login").otherwise("fine")
    doc = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see SENS_20240131_a"), F.col("page_id").cast("string"), F.lit(".pdf now"))).otherwise("SENS_1.pdf")
    return table(spark, sf, "pages").select("page_id", T.access_issue(says).alias("issue"), T.pdf_reference(doc).alias("document"))


PLACES = "SELECT p_partkey AS key, 'http://h.example' || CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '/PDF/' WHEN 1 THEN '/ost/PDF/' ELSE '/x/' END || p_partkey || '.pdf' || CASE WHEN p_partkey % 2 = 0 THEN '?id=' || p_size || '&z=1' ELSE '' END AS url FROM {part}"


@query("SELECT key, CASE key % 3 WHEN 0 THEN url || ' ' || replace(url, 'example/PDF', 'example/ost/PDF') || ' ' || replace(url, 'example/PDF', 'example/ost/sp/profilem/PDF') WHEN 1 THEN url || ' ' || replace(url, '/ost/PDF', '/ost/sp/profilem/PDF') ELSE url END AS places, nullif(regexp_extract(url, '[?&]id=([^&]*)', 1), '') AS article, key || '.pdf' AS name FROM places", places=PLACES)
def other_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where else a document may lie, the id in its address, and its name."""
    url = F.col("url")
    return relation(spark, sf, PLACES).select("key", F.array_join(T.other_places(url), " ").alias("places"), T.query_value(url, "id").alias("article"), T.download_name(F.lit(None).cast("string"), url).alias("name"))


@query("SELECT key, CASE key % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS research FROM watchlist")
def research_present(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts say anything: not missing, blank or a placeholder."""
    from larkspur.sources import watchlist

    k = F.col("key") % 4
    text = F.when(k == 1, "  ").when(k == 2, F.col("name")).when(k == 3, " N/A ")
    return watchlist(spark, sf).select("key", T.is_research(text).alias("research"))


@query("SELECT event_id, isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) BETWEEN 420 AND 1350 AS at_work, CASE WHEN isodow(ts) < 6 AND hour(ts) * 60 + minute(ts) BETWEEN 420 AND 1350 THEN 900 ELSE 600 END AS wait FROM events")
def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a time is in working hours, and the seconds to the next round."""
    from larkspur import functions as X

    return table(spark, sf, "events").select("event_id", X.at_work(F.col("ts")).alias("at_work"), X.poll_seconds(F.col("ts")).alias("wait"))


#: Links out of each page's own menu, made relative in several ways.
MENU = r"""SELECT page_id, url, CASE CAST((page_id + i) % 6 AS INT) WHEN 0 THEN href WHEN 1 THEN '..' || href WHEN 2 THEN 'a/./b/..' || href || '/' WHEN 3 THEN '../../..' || href || '?k=/../1' WHEN 4 THEN '//other.example' || href ELSE '.' || CHR(92) || 'x' || href || '/..' END AS link, i
  FROM (SELECT page_id, url, p.i AS i, p.m AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="(/[A-Za-z]*)', 1) AS found FROM {pages}) LATERAL VIEW posexplode(found) p AS i, m)"""
_MENU_SQL = MENU.replace("(SELECT page_id, url, p.i AS i, p.m AS href FROM (SELECT", "(SELECT page_id, url, generate_subscripts(found, 1) - 1 AS i, unnest(found) AS href FROM (SELECT").replace(" LATERAL VIEW posexplode(found) p AS i, m)", ")")


@query(f"SELECT page_id, i::INT AS i, {absolute('link', 'url')} AS absolute FROM ({_MENU_SQL.replace('{pages}', 'pages')})")
def menu_links(spark: SparkSession, sf: str) -> DataFrame:
    """Where the links of each page lead, seen from the page's own address."""
    return relation(spark, sf, MENU).select("page_id", "i", T.absolute_url(F.col("url"), F.col("link")).alias("absolute"))


#: Whole texts of documents with what sites say when they don't show a page: in other cases, with words between, or only a part of it.
WALLS = """SELECT doc_id, CASE CAST(length(text) % 9 AS INT) WHEN 0 THEN 'You need a <b>Premium</b> ' || text || ' subscription' WHEN 1 THEN text || 'YOU NEED A better SUBSCRIPTION' WHEN 2 THEN 'You have not accepted the Terms of Use ' || text || ' or Conditions of Subscription' WHEN 3 THEN text || ' you need to be logged on as a ' || text || ' Free Registered User'
  WHEN 4 THEN 'login ' || text || ' is CONCURRENT' WHEN 5 THEN 'concurrent ' || text WHEN 6 THEN 'You need to be logged on as a free registered user with a concurrent login; you need a premium subscription' || text WHEN 7 THEN text || ' SENS_' || lpad(CAST(doc_id AS STRING), 8, '2') || '_Ab9.pdf, SENS_20240102_late.pdf' ELSE 'XSENS_20240101_no.pdf ' || text || ' SENS_2024_no.pdf' END AS html
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM {documents})"""


@query(r"""SELECT doc_id, CASE WHEN h LIKE '%you need a%' AND h LIKE '%premium%' AND h LIKE '%subscription%' THEN 'premium' WHEN h LIKE '%you have not accepted the terms of use%' AND h LIKE '%conditions of subscription%' THEN 'terms'
  WHEN h LIKE '%you need to be logged on as a%' AND h LIKE '%free registered user%' THEN 'anonymous' WHEN h LIKE '%concurrent%' AND h LIKE '%login%' THEN 'concurrent' END AS issue, nullif(regexp_extract(html, '\bSENS_\d{8}_[A-Za-z0-9]+\.pdf\b'), '') AS document FROM (SELECT *, lower(html) AS h FROM walls)""", walls=WALLS)
def text_walls(spark: SparkSession, sf: str) -> DataFrame:
    """Why a page wasn't shown, and the first document that it names, by its whole text."""
    t = F.col("html")
    return relation(spark, sf, WALLS).select("doc_id", T.access_issue(t).alias("issue"), T.pdf_reference(t).alias("document"))


#: What people leave where research should be, chosen by the text itself.
LEFT = """SELECT conv_id, turn, CASE CAST(length(text) % 10 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN ' N/A ' WHEN 4 THEN 'None' WHEN 5 THEN ' no data' WHEN 6 THEN 'n/a.' WHEN 7 THEN 'PLACEHOLDER' WHEN 8 THEN '  ' || text || ' n/a' ELSE text END AS t FROM {conversations}"""


@query("SELECT conv_id, turn, t IS NOT NULL AND trim(t) <> '' AND lower(trim(t)) NOT IN ('n/a', 'none', 'no data', 'placeholder') AS present, coalesce(trim(t), '') = '' AS blank FROM left_texts", left_texts=LEFT)
def text_present(spark: SparkSession, sf: str) -> DataFrame:
    """Which texts say anything, and which are null or blank."""
    t = F.col("t")
    return relation(spark, sf, LEFT).select("conv_id", "turn", T.is_research(t).alias("present"), (F.coalesce(F.trim(t), F.lit("")) == "").alias("blank"))
