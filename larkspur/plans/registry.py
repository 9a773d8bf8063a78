"""The registry of queries with their SQL, and relations that both engines read from one text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources import SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The day that stands for today.
AS_OF = "2024-01-31"


def query(sql: str | None = None, **relations: str):
    """Registers a query and, after ``WITH`` of the domain relations and of ``relations``, its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            more = "".join(f",\n{name} AS ({plain(text)})" for name, text in relations.items())
            ORACLES[f.__name__] = f"WITH {SQL}{more}\n{sql}"
        return f

    return add


def plain(text: str) -> str:
    """A relation's text with the names of tables instead of their placeholders."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def relation(spark: SparkSession, sf: str, text: str, **given: DataFrame) -> DataFrame:
    """The rows of a relation: ``{name}`` stands for a table of the folder, or for one of the given frames."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: given[n] if n in given else table(spark, sf, n) for n in names})
