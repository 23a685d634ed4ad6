"""Ordering and top-N reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tristrata.operators.gold import aggregate
from tristrata.plans.specs import Metric


def order_by_period(df: DataFrame, date: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in date order, the first ``limit`` of them if given."""
    ordered = df.orderBy(F.desc(date) if descending else F.asc(date))
    return ordered if limit is None else ordered.limit(limit)


def top_n(df: DataFrame, keys: Sequence[str], metric: Metric, n: int = 20) -> DataFrame:
    """The ``n`` groups with the greatest metric; equal ones in key order.

    Each task keeps its own best ``n``, so nothing but those is sorted at the end.
    """
    return (df.groupBy(*keys).agg(aggregate(metric))
              .orderBy(F.desc_nulls_last(metric.name), *keys).limit(n))
