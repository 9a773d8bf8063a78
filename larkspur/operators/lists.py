"""Ordered lists with tags and filters: every order states where nulls stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the states in the main list.
STATES = {"Active-Trade": 0, "Pre-Trade": 1, "WL-Active": 2}
NO_EVENT = 999_999


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows; all with 0 or None."""
    return df.limit(n) if n else df


def days_to(event: Column, as_of: Column) -> Column:
    return F.datediff(event, as_of)


def days_text(event: Column, as_of: Column) -> Column:
    """``12d``; ``-`` without a date."""
    return F.coalesce(F.concat(days_to(event, as_of).cast("string"), F.lit("d")), F.lit("-"))


def soon(event: Column, as_of: Column, within: int = 30) -> Column:
    """Whether an event is less than ``within`` days away and not over."""
    return F.coalesce(days_to(event, as_of).between(0, within - 1), F.lit(False))


def next_event_days(day: Column, as_of: Column, none: int = 999) -> Column:
    """An aggregate: days to the nearest event that isn't over."""
    return F.coalesce(F.min(F.when(day >= as_of, F.datediff(day, as_of))), F.lit(none))


def state_rank(status: Column) -> Column:
    out = F.lit(len(STATES))
    for name, rank in STATES.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def by_state(df: DataFrame, as_of: Column) -> list[Column]:
    """Sort keys: the state, then days to the next event (past ones first, missing ones last)."""
    return [state_rank(F.col("status")).asc(), F.coalesce(days_to(F.col("event"), as_of), F.lit(NO_EVENT)).asc()]


#: Named row filters; an unknown name filters nothing.
def views() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "active": ~F.col("status").eqNullSafe("WL-Sleep"),
        "sleep": F.col("status").eqNullSafe("WL-Sleep"),
        "unread": F.coalesce("unread", F.lit(0)) > 0,
        "holding": F.coalesce("holding", F.lit(False)),
        "pre-trade": F.col("status").eqNullSafe("Pre-Trade"),
        "no-research": F.coalesce(F.trim("research"), F.lit("")) == "",
    }


def view(df: DataFrame, name: str) -> DataFrame:
    return df.where(views().get((name or "all").strip().lower(), F.lit(True)))


def tag(as_of: Column) -> Column:
    """What a row stands out for: unread news, new research that nobody has seen, a holding, a trade to come, no research."""
    new = (F.col("research_day") == as_of) & ~F.coalesce("seen", F.lit(False))
    return (
        F.when(F.coalesce("unread", F.lit(0)) > 0, "unread").when(new, "new_deepresearch").when(F.coalesce("holding", F.lit(False)), "holding")
        .when(F.col("status") == "Pre-Trade", "pretrade").when(F.coalesce("research", F.lit("")) == "", "no_research").otherwise("")
    )


#: Columns of the list whose missing values come last in both directions; those of the others come first when reversed.
ALWAYS_LAST = ("bte", "peg")


def column_order(name: str, reverse: bool = False) -> Column:
    """The sort key of a list's column in a direction."""
    key = F.lower(F.col(name)) if name == "name" else F.col(name)
    if not reverse:
        return key.asc_nulls_last()
    return key.desc_nulls_last() if name in ALWAYS_LAST else key.desc_nulls_first()


def first_matches(df: DataFrame, key: str, order: list[Column], n: int, ok: Column) -> DataFrame:
    """The first ``n`` rows of each key that meet a condition; others don't count."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(ok).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def neighbours(df: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Adds the next and the previous value of the order, with the last's next being the first.

    Without ``by`` the list is one: lists that grow with the data need one.
    """
    w = Window.partitionBy(F.lit(1) if by is None else F.col(by)).orderBy(order)
    ends = Window.partitionBy(F.lit(1) if by is None else F.col(by))
    return df.withColumns({"next": F.coalesce(F.lead(order).over(w), F.min(order).over(ends)), "previous": F.coalesce(F.lag(order).over(w), F.max(order).over(ends))})


def within_budget(df: DataFrame, by: str, order: list[str], size: str, most: int) -> DataFrame:
    """The rows of each key, in order, as long as their sizes together stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= most).drop("_sum")


def first_variant(keys: DataFrame, values: DataFrame, id: str, candidates: Column, key: str, value: Column) -> DataFrame:  # noqa: A002
    """For each row the value of the first of its candidate keys that has one."""
    spread = keys.select(id, F.posexplode(F.array_distinct(candidates)).alias("_rank", key))
    found = values.groupBy(key).agg(value.alias("_value")).where("_value IS NOT NULL")
    best = spread.join(found, key).groupBy(id).agg(F.min_by("_value", "_rank").alias("value"))
    return keys.join(best, id, "left")
