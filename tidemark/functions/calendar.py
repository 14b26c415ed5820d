"""Calendar and ratio expressions; all built-in, null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(d: Column) -> Column:
    """Monday 0 .. Sunday 6."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def week_ending_sunday(d: Column) -> Column:
    return F.date_add(F.trunc(d, "WEEK"), 6)


def calendar_columns(d: Column) -> dict[str, Column]:
    """Parts of a date, ISO week included."""
    return {"day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d), "week_of_year": F.weekofyear(d), "month": F.month(d), "quarter": F.quarter(d), "is_weekend": is_weekend(d)}


def relative_change(now: Column, before: Column) -> Column:
    """(now - before) / before, null for a null or zero base."""
    return F.try_divide(now - before, before)


def null_if_blank(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def near_edge(d: Column, first: Column, last: Column, days: int = 7) -> Column:
    """Which edge of [first, last] a date is near: start, end, both or interior."""
    start, end = F.datediff(d, first) <= days, F.datediff(last, d) <= days
    return F.when(start & end, "both").when(start, "start").when(end, "end").otherwise("interior")


def fractional(v: Column) -> Column:
    """Not a whole number, with absolute tolerance 1e-9 and relative tolerance 1e-5."""
    return F.abs(v - F.bround(v)) > 1e-9 + 1e-5 * F.abs(F.bround(v))


def magnitude(v: Column) -> Column:
    return F.when(v.isNull(), "missing").when(v < 0, "negative").when(v == 0, "zero").when(v <= 10, "to 10").when(v <= 100, "to 100").otherwise("above 100")


def whole_week(week_end: Column, first: Column, last: Column) -> Column:
    """Whether [first, last] holds the whole week that ends then."""
    return (F.date_sub(week_end, 6) >= first) & (week_end <= last)


def whole_month(month_end: Column, first: Column, last: Column) -> Column:
    """Whether [first, last] holds the whole month that ends then."""
    return (F.trunc(month_end, "MM") >= first) & (month_end <= last)


def recoded(v: Column, table: dict, missing: str) -> Column:
    """What a dictionary holds for a value; null becomes `missing`, what it does not hold stays as it is."""
    out = F.when(v.isNull(), missing)
    for key, value in table.items():
        out = out.when(v == key, value)
    return out.otherwise(v)


def count_bucket(v: Column) -> Column:
    return F.when(v.isNull(), "missing").when(v < 0, "negative").when(v == 0, "0").when(v == 1, "1").otherwise("over 1")


def within(v: Column, low: float, high: float) -> Column:
    """Strictly between two bounds; null is not."""
    return F.coalesce((v > low) & (v < high), F.lit(False))


def weekdays_of(start: Column, end: Column) -> Column:
    """Weekdays (Monday 0) that a block of days touches, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(start, end), lambda d: F.weekday(d))))
