"""Operators over texts that need more than an expression: footers, template matching, checked analyses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import lists as L

# What marks the end of an announcement.
PRODUCER = r"(?i)\bproduced\s+by\b.*\bsens\b"
DAY = r"(?i)^\s*date\s*:\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
SPONSOR = r"(?i)\bspon(?:s|c)or\b"
BOILERPLATE = r"(?im)\bproduced\s+by\b|\bthe\s+sens\s+service\b|\bthe\s+jse\s+does\s+not\b|^\s*date\s*:"
#: Shares of a text's lines after which a sponsor's line or a date can belong to a footer, and the most lines of a sponsor's block.
LATE_SPONSOR, LATE_DAY, BLOCK = 0.6, 0.7, 3


def _first(flags: Column) -> Column:
    """How many flags come before the first that is set; null if none is."""
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1


def _last(flags: Column) -> Column:
    return F.size(flags) - 1 - _first(F.reverse(flags))


def _from(x: Column, at: Column) -> Column:
    """The array without its first ``at`` elements."""
    return F.slice(x, at + 1, F.greatest(F.size(x) - at, F.lit(0)))


def footer(lines: Column) -> Column:
    """(keep, reason): how many lines of a tidy text come before its footer, and what marks that.

    The first line that names producer and service ends a text.  Without one, it
    ends below the last sponsor's block if that stands late and a marker follows:
    blank lines after the sponsor's line, then lines up to a blank one, ``BLOCK`` at most.
    Else it ends at the last date line, if that stands late, itself a marker.
    """
    n = F.size(lines)
    has = lambda pattern: F.transform(lines, lambda x: x.rlike(pattern))
    written = F.transform(lines, lambda x: ~x.rlike(r"(?U)^\s*$"))
    produced, sponsor, day = _first(has(PRODUCER)), _last(has(SPONSOR)), _last(has(DAY))
    below = _from(written, sponsor + 1)
    gap = F.coalesce(_first(below), F.size(below))
    block = F.slice(_from(below, gap), 1, BLOCK)
    end = sponsor + 1 + gap + F.coalesce(_first(F.transform(block, lambda x: ~x)), F.size(block))
    marked = lambda at: F.array_join(_from(lines, at), "\n").rlike(BOILERPLATE)
    late = lambda at, share: at >= F.floor(F.lit(share) * n)
    said = lambda keep, reason: F.struct(keep.cast("int").alias("keep"), F.lit(reason).alias("reason"))
    return (
        F.when(produced.isNotNull(), said(produced, "cut_at_produced_by"))
        .when(late(sponsor, LATE_SPONSOR) & marked(end), said(end, "cut_after_sponsor_block"))
        .when(late(day, LATE_DAY) & marked(day), said(day, "cut_at_date_line"))
        .otherwise(said(n, "no_change"))
    )


def trimmed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, reason, original_chars, trimmed_chars): texts without the footers of announcements."""
    tidy = df.select(key, T.normalised(F.col(text)).alias("_tidy")).withColumn("_lines", F.split(F.regexp_replace("_tidy", r"\n\z", ""), "\n"))
    cut = tidy.withColumn("_cut", F.when(F.col("_tidy") == "", F.struct(F.lit(0).alias("keep"), F.lit("empty").alias("reason"))).otherwise(footer(F.col("_lines"))))
    kept = F.when(F.col("_cut.reason").isin("no_change", "empty"), F.col("_tidy")).otherwise(T.normalised(F.array_join(F.slice("_lines", F.lit(1), F.col("_cut.keep")), "\n")))
    return cut.select(key, kept.alias(text), F.col("_cut.reason").alias("reason"), F.length("_tidy").alias("original_chars"), F.length(kept).alias("trimmed_chars"))


def matched(rows: DataFrame, category: str, templates: DataFrame, stem: str, fallback: str) -> DataFrame:
    """Adds the template of each category; equal keys come first, then one that is part of the other, by name, then the fallback.

    Templates are a short list of files: they are broadcast as one array.
    """
    names = templates.agg(F.array_sort(F.collect_list(F.struct(F.col(stem).alias("stem"), T.category_slug(F.col(stem)).alias("slug")))).alias("_all"))
    r = rows.join(F.broadcast(names)).withColumn("_slug", T.category_slug(F.col(category))).withColumn("_forms", T.variants(F.col("_slug")))
    within = lambda a, b: a.contains(b) | b.contains(a)
    near = F.filter("_all", lambda t: F.exists("_forms", lambda c: F.exists(T.variants(t["slug"]), lambda v: within(c, v))))
    same = F.filter("_all", lambda t: t["slug"] == F.col("_slug"))
    best = F.coalesce(F.try_element_at(same, F.lit(1))["stem"], F.try_element_at(near, F.lit(1))["stem"], F.lit(fallback))
    return r.select(*rows.columns, F.when(F.coalesce(F.trim(category), F.lit("")) == "", fallback).otherwise(best).alias("template"))


Analyzer = Callable[[pd.Series], pd.Series]


def summary(prompts: pd.Series) -> pd.Series:
    """The analyzer that comes with the library: no model, the same reply for the same prompt."""
    level = prompts.str.len() % 3
    return "# Analysis\nSignificance: " + level.map({0: "Low", 1: "Medium", 2: "High"}) + "\n" + prompts.str.slice(0, 80)


def analysed(df: DataFrame, prompt: str, analyzer: Analyzer = summary, out: str = "analysis") -> DataFrame:
    """Adds what the analyzer makes of each prompt: any function of a series of texts, called for Arrow batches."""
    return df.withColumn(out, F.pandas_udf(analyzer, "string")(F.col(prompt)))


def logged(news: DataFrame, context: DataFrame, key: str, analyzer: Analyzer = summary) -> DataFrame:
    """(the columns of ``news`` but its content, trigger_content, ai_analysis, significance) of announcements of keys that have a context; others are left out."""
    from larkspur import functions as X

    both = news.join(context, key)
    prompt = T.filled("{name}: {content}\nStrategy: {strategy}", name=F.col("name"), content=F.col("content"), strategy=F.col("strategy"))
    told = analysed(both.withColumn("_prompt", prompt), "_prompt", analyzer)
    return told.select(*(c for c in news.columns if c != "content"), T.shortened(F.col("content"), 200).alias("trigger_content"), F.col("analysis").alias("ai_analysis"), X.significance(F.col("analysis")).alias("significance"))


def researched(rows: DataFrame, key: str, research: str, templates: DataFrame, stem: str, fallback: str, analyzer: Analyzer = summary) -> DataFrame:
    """(key, template, research, fault) of the rows that lack research: their template, the analyzer's report, and why that isn't one."""
    missing = rows.where(~T.is_research(F.col(research)))
    asked = matched(missing, "category", templates, stem, fallback)
    prompt = T.filled("Template {template}\nCompany {name}", template=F.col("template"), name=F.col("name"))
    told = analysed(asked.withColumn("_prompt", prompt), "_prompt", analyzer, "_report")
    fault = T.report_fault(F.col("_report"))
    return told.select(key, "template", F.when(fault.isNull(), F.col("_report")).alias("research"), fault.alias("fault"))


def held_text(files: DataFrame, folder: str, name: str, text: str, most: int) -> DataFrame:
    """(folder, text): the files of each folder by name, as many as fit whole into ``most`` characters."""
    w = Window.partitionBy(folder).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    fit = files.withColumn("_sum", F.sum(F.length(text)).over(w)).where(F.col("_sum") <= most)
    return fit.groupBy(folder).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, text))), lambda x: x[text]), "\n").alias(text))


#: Fixed value: what stands above each file's text.
HEADING = ("\n\n===== FILE: ", " =====\n\n")
_BLANK = r"[ \t\n\x0B\f\r]+"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_BLANK}|{_BLANK}$", "")


def gathered(files: DataFrame, by: str, name: str, text: str, most: int, salts: int = 32) -> DataFrame:
    """(by, files, text): of each folder the files in order of their names, each below its heading, up to the first that would pass ``most`` characters.

    Names are unique within a folder; a missing text is empty. A folder whose first file is too long has
    an empty line alone. Every heading has characters, so no more than ``most`` by its length can
    be used: a folder with very many files is cut to these in pieces before its lengths are summed up in one
    place, and texts move only once it is known which are used.
    """
    heading = F.concat(F.lit(HEADING[0]), F.col(name), F.lit(HEADING[1]))
    chunk = F.concat(heading, stripped(F.col(text)), F.lit("\n"))
    able = most // (sum(map(len, HEADING)) + 1) + 1
    piece = Window.partitionBy("_g", "_salt").orderBy("_n")
    sized = files.select(F.col(by).alias("_g"), F.col(name).alias("_n"), F.length(chunk).alias("_size")).withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(salts)))
    first = sized.withColumn("_k", F.row_number().over(piece)).where(F.col("_k") <= able)
    used = L.within_budget(first, "_g", ["_n"], "_size", most).select("_g", "_n")
    kept = files.select(F.col(by).alias("_by"), F.col(name).alias("_name"), chunk.alias("_c")).join(used, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_name") == F.col("_n")))
    joined = kept.groupBy("_g").agg(F.count(F.lit(1)).alias("_files"), F.array_join(F.sort_array(F.collect_list(F.struct("_name", "_c")))["_c"], "").alias("_text"))
    folders = files.select(F.col(by).alias("_by")).distinct()
    found = folders.join(joined, F.col("_by").eqNullSafe(F.col("_g")), "left")
    return found.select(F.col("_by").alias(by), F.coalesce("_files", F.lit(0)).alias("files"), F.concat(stripped(F.col("_text")), F.lit("\n")).alias("text"))
