"""Dates as Columns; "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that a patent lasts.
PATENT_LIFE = 20


def between_years(date: Column, start_year: int, end_year: int) -> Column:
    """From 1 January of ``start_year`` to 1 January of ``end_year``, both included, as a range that reaches the scan."""
    return (date >= F.lit(f"{start_year}-01-01").cast("timestamp_ntz")) & (date <= F.lit(f"{end_year}-01-01").cast("timestamp_ntz"))


def from_year(date: Column, year: int) -> Column:
    return date >= F.lit(f"{year}-01-01").cast("timestamp_ntz")


def year_of(date: Column) -> Column:
    return F.year(date).cast("long")


def duration_days(start: Column, end: Column, as_of: str) -> Column:
    """-1 without a start; up to ``as_of`` without an end."""
    return F.when(start.isNull(), -1).otherwise(F.datediff(F.coalesce(F.to_date(end), F.lit(as_of).cast("date")), F.to_date(start))).cast("long")


def clipped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def patent_years(date: Column, as_of_year: int) -> Column:
    return clipped(PATENT_LIFE - (as_of_year - F.year(date)), 0, PATENT_LIFE)


def year_spine(first: Column, last: Column) -> Column:
    """Years first..last; empty where first is later (a plain sequence would count down)."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
