"""Comparing periods of an aggregate.

Input has one row per period and dimension values, so a window holds at most as many rows as there are
periods; without dimensions that is the whole, small, aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tristrata.functions.scalars import grain_unit, safe_divide

_STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}


def fill_periods(df: DataFrame, date: str, grain: str, dimensions: Sequence[str] = ()) -> DataFrame:
    """Add a row with NULL metrics for each period missing between a group's first and last one."""
    span = df.groupBy(*dimensions).agg(F.min(date).alias("__from"), F.max(date).alias("__to"))
    step = F.expr(_STEP[grain_unit(grain)])
    periods = span.select(*dimensions, F.explode(F.sequence("__from", "__to", step)).alias(date))
    undated = df.filter(F.col(date).isNull())
    facts = df.filter(F.col(date).isNotNull()).withColumnsRenamed({c: f"__r_{c}" for c in [*dimensions, date]})
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in [*dimensions, date]]
    filled = periods.join(facts, on, "left")
    return filled.select(df.columns).unionByName(undated)


def previous_period(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] = (), alias: str = "previous_period",
    grain: str | None = None, fill: bool = False,
) -> DataFrame:
    """The metric of the row before in date order, per dimension values.

    Missing periods are not counted, so the row before can be older than one period; ``fill`` adds them.
    """
    if fill:
        if grain is None:
            raise ValueError("fill needs the grain of the aggregate")
        df = fill_periods(df, date, grain, dimensions)
    return df.withColumn(alias, F.lag(metric).over(Window.partitionBy(*dimensions).orderBy(date)))


def period_change(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] = (), **options
) -> DataFrame:
    """``previous_period``, ``change`` to it and ``growth_rate`` (NULL when the previous value is zero)."""
    df = previous_period(df, metric, date, dimensions, **options)
    before = options.get("alias", "previous_period")
    change = F.col(metric) - F.col(before)
    return df.withColumns({"change": change, "growth_rate": safe_divide(change, before)})


def cumulative(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] = (), alias: str = "cumulative"
) -> DataFrame:
    """Running total in date order, per dimension values."""
    window = Window.partitionBy(*dimensions).orderBy(date)
    total = F.sum(metric).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(alias, total)


def year_to_date(
    df: DataFrame, metric: str, date: str, dimensions: Sequence[str] = (), alias: str = "year_to_date"
) -> DataFrame:
    """Running total that starts again each calendar year."""
    window = Window.partitionBy(*dimensions, F.year(date)).orderBy(date)
    total = F.sum(metric).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(alias, total)
