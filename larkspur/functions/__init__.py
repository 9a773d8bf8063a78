"""Row expressions: valuation, levels, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = 0.02


def dec(x: Column, scale: int = 4) -> Column:
    return x.cast(f"decimal(18,{scale})")


def years(days: Column) -> Column:
    return days / F.lit(365.25)


def cagr(start: Column, end: Column, days: Column) -> Column:
    """Yearly growth in per cent; null unless both ends are positive and a year has passed."""
    return F.when((start > 0) & (end > 0) & (years(days) >= 1), (F.pow(end / start, F.lit(1.0) / years(days)) - 1) * 100)


def peg(price: Column, start: Column, end: Column, days: Column) -> Column:
    """The price to earnings ratio over the yearly growth; null unless earnings have grown."""
    return F.when((start > 0) & (end > start), F.try_divide(price / end, cagr(start, end, days)))


def fair_value(earnings: Column, assets: Column) -> Column:
    """The square root of 22.5 times earnings and net assets of a share; null unless both are positive."""
    return F.when((earnings > 0) & (assets > 0), F.sqrt(F.lit(22.5) * earnings * assets))


def reward_risk(target: Column, entry: Column, stop: Column, is_long: Column) -> Column:
    """Reward over risk with two places; null if an input is missing or there is no risk."""
    long = F.coalesce(is_long, F.lit(True))
    reward = F.when(long, target - entry).otherwise(entry - target)
    risk = F.when(long, entry - stop).otherwise(stop - entry)
    return F.when(risk > 0, F.round(reward.cast("decimal(18,0)") / risk.cast("decimal(18,0)"), 2).cast("decimal(12,2)"))


def proximity(price: Column, entry: Column, target: Column, stop: Column, is_long: Column, near: float = NEAR) -> Column:
    """Which level the price is at: Stop, Entry, Target, else Away; No Data without a price."""
    some = lambda x: F.coalesce(x != 0, F.lit(False))
    at_stop = F.when(is_long, price <= stop * (1 + near)).otherwise(price >= stop * (1 - near))
    at_entry = F.when(is_long, (price >= entry) & (price <= entry * (1 + near))).otherwise((price > entry * (1 - near)) & (price < entry))
    at_target = F.abs(price - target) / target <= near
    return F.when(price.isNull(), "No Data").when(some(stop) & at_stop, "Stop").when(some(entry) & at_entry, "Entry").when(some(target) & at_target, "Target").otherwise("Away")


def number(text: Column) -> Column:
    """A number with spaces, no-break spaces or a Unicode minus; null for placeholders and commas."""
    return F.translate(F.trim(text), "−  ", "-").try_cast("double")  # placeholders are no numbers


def period_end(label: Column) -> Column:
    """Month end of a label like ``Mar 2024 (12m)``."""
    month, year = F.regexp_extract(label, r"^([A-Za-z]{3})[A-Za-z]*\s*(\d{4})", 1), F.regexp_extract(label, r"^([A-Za-z]{3})[A-Za-z]*\s*(\d{4})", 2)
    return F.last_day(F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(month), F.lit(" "), year), F.lit("d MMM yyyy")).cast("date"))


def significance(text: Column) -> Column:
    """Low, Medium or High after the word significance; null if there is none."""
    return F.nullif(F.initcap(F.lower(F.regexp_extract(text, r"(?i)significance\W+(low|medium|high)", 1))), F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ingest_window(last: Column, as_of: Column) -> list[Column]:
    """(kind, first_day, end_day): everything without a last day, the last two days, or from the day after the last one."""
    gap = F.datediff(as_of, last)
    kind = F.when(last.isNull(), "all").when(gap <= 2, "short").otherwise("range")
    return [kind.alias("kind"), F.when(gap > 2, F.date_add(last, 1)).alias("first_day"), F.when(gap > 2, F.date_add(as_of, 1)).alias("end_day")]


def at_work(now: Column) -> Column:
    """Whether a time is on a weekday between 7:00 and 22:30."""
    minutes = F.hour(now) * 60 + F.minute(now)
    return (F.weekday(now) < 5) & minutes.between(7 * 60, 22 * 60 + 30)


def poll_seconds(now: Column) -> Column:
    """How long to wait for the next round."""
    return F.when(at_work(now), 900).otherwise(600)


def is_long(entry: Column, target: Column, strict: bool = False) -> Column:
    """The direction that the levels imply: equal ones are long unless ``strict``."""
    return (target > entry) if strict else (target >= entry)


def bte(price: Column, entry: Column, is_long: Column) -> Column:
    """By how many per cent a price is better than the entry; 0 with an entry of 0."""
    better = F.when(F.coalesce(is_long, F.lit(True)), entry - price).otherwise(price - entry)
    return F.when(entry == 0, 0.0).otherwise(better * F.lit(100.0) / entry)
