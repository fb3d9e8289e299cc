"""Dates inside arrays of events, and labels of periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_between(days: Column, start: date | Column, end: date | Column) -> Column:
    """1 if any date of the array is in [start, end], else 0."""
    return F.coalesce(F.exists(days, lambda d: (d >= F.lit(start)) & (d <= F.lit(end))), F.lit(False)).cast("int")


def days_between(days: Column, start: date | Column, end: date | Column) -> Column:
    """The dates of the array in [start, end]; none for null."""
    return F.coalesce(F.filter(days, lambda d: (d >= F.lit(start)) & (d <= F.lit(end))), F.array().cast("array<date>"))


def first_day(days: Column) -> Column:
    return F.array_min(days)


def last_day(days: Column) -> Column:
    return F.array_max(days)


def last_id(events: Column, day: str = "day", key: str = "id") -> Column:
    """Id of the latest event of an array of structs; among equal dates the largest id."""
    return F.array_max(F.transform(events, lambda e: F.struct(e[day], e[key])))[key]


def period_label(when: Column, period: str) -> Column:
    """2001, 2001-Q2 or 2001-04."""
    if period == "year":
        return F.year(when).cast("string")
    if period == "quarter":
        return F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string"))
    if period == "month":
        return F.date_format(when, "yyyy-MM")
    raise ValueError(f"no label for {period!r}")


def from_millis(x: Column) -> Column:
    """Timestamp of milliseconds since 1970."""
    return F.timestamp_millis(x)
