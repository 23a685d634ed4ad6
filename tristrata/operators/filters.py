"""Row filters on date columns. ``as_of`` defaults to today; pass it for repeatable results."""

from __future__ import annotations

from datetime import date as Date, datetime

from pyspark.sql import Column, DataFrame, functions as F


def _day(as_of: Date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def filter_recent(df: DataFrame, date: str, days: int = 30, as_of: Date | str | None = None) -> DataFrame:
    """Rows of the last ``days`` days, the first of them included."""
    return df.filter(F.col(date) >= F.date_sub(_day(as_of), days))


def filter_between(df: DataFrame, date: str, start: Date | datetime | str, end: Date | datetime | str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    kind = df.schema[date].dataType
    return df.filter(F.col(date).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def filter_year(df: DataFrame, date: str, as_of: Date | str | None = None) -> DataFrame:
    """Rows of ``as_of``'s calendar year, as a range so that it reaches the scan."""
    first = F.trunc(_day(as_of), "year")
    return df.filter((F.col(date) >= first) & (F.col(date) < F.add_months(first, 12)))


def filter_current(df: DataFrame) -> DataFrame:
    """Only the current versions of an SCD2 dimension."""
    return df.filter("is_current")
