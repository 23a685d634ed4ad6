"""Column helpers: division guard, NULL handling, time grains."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Accepted grain names and the calendar unit each one truncates to.
GRAIN_UNITS = {
    "daily": "day", "day": "day",
    "weekly": "week", "week": "week",
    "monthly": "month", "month": "month",
    "yearly": "year", "year": "year",
}

# A quoted literal, or a slash followed by a bare column that is not a function call.
_DIVISION = re.compile(r"'(?:[^']|'')*'|/\s*(`[^`]+`|[A-Za-z_][\w.]*\b)(?!\s*\()")


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / denominator``, NULL when the denominator is zero (a bare ``/`` raises under ANSI).

    Division is fractional even between integers.
    """
    return _col(numerator) / F.nullif(_col(denominator), F.lit(0))


def guard_division(expression: str) -> str:
    """Make every ``/ column`` in a SQL expression NULL-safe; applying it twice changes nothing."""
    def guard(match: re.Match) -> str:
        return f"/ nullif({match[1]}, 0)" if match[1] else match[0]

    return _DIVISION.sub(guard, expression)


def null_to_zero(value: str | Column) -> Column:
    return F.coalesce(_col(value), F.lit(0))


def grain_unit(grain: str) -> str:
    """Calendar unit of a grain name; an unknown name raises instead of silently meaning days."""
    try:
        return GRAIN_UNITS[grain.lower()]
    except KeyError:
        raise ValueError(f"unknown grain {grain!r}; use one of {', '.join(GRAIN_UNITS)}") from None


def to_grain(value: str | Column, grain: str) -> Column:
    """First day of the period holding ``value``, as a date; weeks start on Monday.

    Works on the date part only, so no session time zone enters for zone-less timestamps.
    """
    day, unit = _col(value).cast("date"), grain_unit(grain)
    return day if unit == "day" else F.trunc(day, unit)
