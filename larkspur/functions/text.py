"""Text expressions: symbols, dates, numbers, addresses, names of files, checks of written reports.

All are column expressions. A text that an expression can't read gives null
(ANSI mode would raise), never an error; the day that stands for today is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = ".JO"
#: How a reply begins that reports a failure instead of an analysis.
FAILED_STARTS = ("error", "i cannot", "i'm unable", "i am unable", "sorry", "unfortunately", "as an ai", "i don't have", "i do not have", "quota exceeded", "rate limit")
LEAST_REPORT, LEAST_PLAIN_REPORT = 500, 2000


def bare_ticker(t: Column) -> Column:
    """Without blanks around it and without the market's suffix, in any case."""
    return F.regexp_replace(F.trim(t), r"(?i)\.JO$", "")


def market_ticker(t: Column, upper: bool = False) -> Column:
    """With the market's suffix; blank stays blank."""
    plain = F.upper(F.trim(t)) if upper else F.trim(t)
    return F.when((plain == "") | F.upper(plain).endswith(SUFFIX), plain).otherwise(F.concat(plain, F.lit(SUFFIX)))


def without_suffix(t: Column) -> Column:
    """The suffix goes wherever it stands, in this case only."""
    return F.replace(t, F.lit(SUFFIX), F.lit(""))


def _date(day: Column, month: Column, year: Column, clock: Column | None = None) -> Column:
    text = F.concat_ws(" ", day, F.initcap(F.substring(month, 1, 3)), year, *([clock] if clock is not None else []))
    return F.try_to_timestamp(text, F.lit("d MMM yyyy" + (" H:mm" if clock is not None else "")))


def release_date(text: Column) -> Column:
    """The first date like ``5 Apr 2024`` in a text."""
    part = lambda k: F.regexp_extract(text, r"(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})", k)
    return _date(part(1), part(2), part(3)).cast("date")


def headline_time(text: Column) -> Column:
    """``09 Dec 2025 17:05``, ``9-Dec-2025`` or ``1 Sept 2025``, whatever the language of the machine; no other month of four letters."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{1,2})\s*(?:-|\s)\s*([A-Za-z]{3,4})\s*(?:-|\s)\s*(\d{4})(?:\s+(\d{1,2}):(\d{2}))?$", k)
    clock = F.when(part(4) == "", "0:00").otherwise(F.concat(part(4), F.lit(":"), part(5)))
    return F.when((F.length(part(2)) == 3) | (F.lower(part(2)) == "sept"), _date(part(1), part(2), part(3), clock))


def announcement_time(attribute: Column, text: Column) -> Column:
    """The machine-readable time without its zone, else a text like ``31.01.24 09:30``."""
    iso = F.try_to_timestamp(F.regexp_replace(F.substring(attribute, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(iso, F.try_to_timestamp(F.trim(text), F.lit("dd.MM.yy HH:mm")))


def any_time(text: Column) -> Column:
    """A time in one of three usual forms; what follows it doesn't matter."""
    t = F.trim(text)
    forms = (("yyyy-MM-dd HH:mm:ss", 19), ("yyyy-MM-dd'T'HH:mm:ss", 19), ("yyyy-MM-dd", 10))
    return F.coalesce(*(F.try_to_timestamp(F.substring(t, 1, n), F.lit(form)) for form, n in forms))


def quote_time(text: Column, as_of: str, clock_only: bool = False) -> Column:
    """``14:05`` is on the day of ``as_of``, ``Dec/18`` in its year."""
    t = F.trim(text)
    clock = F.when(t.contains(":"), F.try_to_timestamp(F.concat(F.lit(f"{as_of} "), t), F.lit("yyyy-MM-dd H:m")))
    if clock_only:
        return clock
    day = F.try_to_timestamp(F.concat(F.lit(f"{as_of[:4]} "), F.initcap(t)), F.lit("yyyy MMM/d"))
    return F.when(t.contains(":"), clock).otherwise(day)


def quote_number(text: Column) -> Column:
    """A price with commas between thousands."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def percent_key(text: Column) -> Column:
    """12.5 of ``(12.5%) Stop``; infinity without a percentage."""
    return F.coalesce(F.regexp_extract(text, r"\(?\s*([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double"), F.lit(float("inf")))


def normalised(text: Column) -> Column:
    """Line ends as ``\\n``, no blanks at line ends, two empty lines in a row at most, none around; one line end at the end."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+(?=\n|\z)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{4,}", "\n\n\n"), r"\A\n+|\n+\z", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def cut_at_producer(text: Column) -> Column:
    """A text up to the first line that names its producer and service."""
    return normalised(F.regexp_replace(normalised(text), r"(?ims)^[^\n]*\bproduced\s+by\b[^\n]*\bsens\b.*\z", ""))


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters, with three dots if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def headline(text: Column, default: str = "") -> Column:
    """The first line of a text without blank ends; ``default`` if there is none."""
    line = F.substring_index(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", 1)
    return F.coalesce(F.nullif(line, F.lit("")), F.lit(default))


def category_slug(text: Column) -> Column:
    """Category names as keys: ``&`` is ``and``, punctuation separates words."""
    t = F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit("and"))
    words = F.trim(F.regexp_replace(t, r"[()\[\]{}.,;:/\\|\"'`\s]+", " "))
    return F.regexp_replace(F.regexp_replace(F.replace(words, F.lit(" "), F.lit("_")), "__", "_"), "^_+|_+$", "")


def variants(slug: Column) -> Column:
    """A key and its simple plural or singular forms."""
    n = F.length(slug)
    most = lambda k: F.substring(slug, F.lit(1), n - k)
    forms = F.array(
        slug,
        F.when(slug.endswith("y") & (n > 1), F.concat(most(1), F.lit("ies"))),
        F.when(slug.endswith("ies") & (n > 3), F.concat(most(3), F.lit("y"))),
        F.when(slug.endswith("s") & (n > 1), most(1)),
    )
    return F.filter(forms, lambda v: v.isNotNull() & (v != ""))


def report_fault(text: Column) -> Column:
    """Why a reply isn't a report: empty, short, failed, plain; null if it is one."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    failed = F.lit(False)
    for start in FAILED_STARTS:
        failed = failed | F.lower(t).startswith(start)
    plain = ~t.contains("#") & (F.length(t) < LEAST_PLAIN_REPORT)
    return F.when(t == "", "empty").when(F.length(t) < LEAST_REPORT, "short").when(failed, "failed").when(plain, "plain")


def is_research(text: Column, placeholders: tuple[str, ...] = ("n/a", "none", "no data", "placeholder")) -> Column:
    """Whether a text says anything: not null, blank or a placeholder."""
    t = F.lower(F.trim(text))
    return F.coalesce((t != "") & ~t.isin(*placeholders), F.lit(False))


def filled(template: str, /, **values: Column) -> Column:
    """A template with its ``{names}`` replaced; a missing value is an empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def file_name(text: Column) -> Column:
    """A text as a file name; ``item`` if nothing is left."""
    t = F.replace(F.regexp_replace(F.trim(text), r"[\\/]", "_"), F.lit(":"), F.lit("-"))
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", "_"), r"[^A-Za-z0-9._-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("item"))


def resource_name(text: Column, most: int = 40) -> Column:
    """Letters, digits and single dashes; a longer name is replaced by a prefix and a part of its digest."""
    slug = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("file"))
    return F.when(F.length(slug) <= most, slug).otherwise(F.concat(F.lit("file-"), F.substring(F.sha1(text.cast("binary")), 1, 12)))


def pdf_reference(text: Column) -> Column:
    """The name of an announcement's document in a text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"\bSENS_\d{8}_[A-Za-z0-9]+\.pdf\b", 0), F.lit(""))


def pdf_link(html: Column) -> Column:
    """The first address of a document in a page."""
    return F.nullif(F.regexp_extract(html, r'(?i)href="([^"]+?\.pdf[^"]*)"', 1), F.lit(""))


def dated_name(day: Column) -> Column:
    """``20240131.pdf``."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit(".pdf"))


def artifact_name(published: Column, article: Column, title: Column, most: int = 160) -> Column:
    """``news_<time>_<id>_<headline>`` of at most ``most`` characters."""
    stamp = F.coalesce(F.date_format(published, "yyyy-MM-dd_HHmm"), F.lit("unknown"))
    name = F.concat_ws("_", F.lit("news"), stamp, F.coalesce(article, F.lit("")), file_name(title))
    return F.substring(F.regexp_replace(name, "^_+|_+$", ""), 1, most)


def anchor_target(href: Column, resolved: Column, onclick: Column) -> Column:
    """Where an anchor leads: its address, else what the page has made of it, else the window that it opens."""
    real = lambda c: F.when((F.trim(c) != "") & ~F.lower(c).startswith("javascript:"), c)
    return F.coalesce(real(href), real(resolved), F.nullif(F.regexp_extract(onclick, r"window\.open\(\s*['\"]([^'\"]+)['\"]", 1), F.lit("")))


def absolute_url(page: Column, link: Column) -> Column:
    """A link as seen from a page: backslashes are slashes, dot segments go, query and fragment stay; null for blank links."""
    value = F.trim(F.replace(link, F.lit("\\"), F.lit("/")))
    site = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    whole = (
        F.when(value.rlike("(?i)^https?://"), value).when(value.startswith("//"), F.concat(scheme, value)).when(value.startswith("/"), F.concat(site, value))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), value))
    )
    part = lambda k: F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", k)
    kept = F.aggregate(
        F.split(part(2), "/"), F.array().cast("array<string>"),
        lambda path, s: F.when(s.isin("", "."), path).when(s == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(s))),
    )
    tail = F.when(part(2).endswith("/") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(value != "", F.concat(part(1), F.lit("/"), F.array_join(kept, "/"), tail, part(3)))


def query_value(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def other_places(url: Column) -> Column:
    """A document's address and the folders where it may lie as well, in the order to try."""
    under = lambda to: F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)(?:/ost)?/PDF/", f"$1{to}/PDF/")
    plain, listed = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/PDF/"), url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/ost/PDF/")
    deep = under("/ost/sp/profilem")
    return F.when(plain, F.array(url, under("/ost"), deep)).when(listed, F.array(url, deep)).otherwise(F.array(url))


def download_name(disposition: Column, url: Column) -> Column:
    """The name that a reply gives, else the end of the address."""
    given = F.regexp_extract(disposition, r'filename=\s*(?:"([^"]*)"|(.*))', 1)
    bare = F.trim(F.regexp_extract(disposition, r'filename=\s*(?:"([^"]*)"|(.*))', 2))
    base = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(bare, F.lit("")), F.nullif(base, F.lit("")), F.lit("download.pdf"))


def access_issue(html: Column) -> Column:
    """Why a page wasn't shown: premium, terms, anonymous, concurrent; null if it was."""
    low = F.lower(html)
    has = lambda *parts: F.expr("true") if not parts else low.contains(parts[0]) & has(*parts[1:])
    return (
        F.when(has("you need a", "premium", "subscription"), "premium").when(has("you have not accepted the terms of use", "conditions of subscription"), "terms")
        .when(has("you need to be logged on as a", "free registered user"), "anonymous").when(has("concurrent", "login"), "concurrent")
    )


def rands(cents: Column) -> Column:
    """``R1,234.50``."""
    return F.concat(F.lit("R"), F.format_number(cents.cast("decimal(18,0)") / 100, 2))


def signed_percent(x: Column) -> Column:
    """``+1.25%`` of a decimal."""
    return F.format_string("%+.2f%%", x.cast("double"))


def whole(x: Column) -> Column:
    """The number without its fraction, toward zero; null for what isn't a number."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")
