"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_order(df: DataFrame, order_by: Sequence[str], among: Sequence[str]) -> Column:
    """Sort key that decides which row is latest: ``order_by`` (NULLs least), then a hash of ``among``."""
    hashable = [c for c, t in df.select(*among).dtypes if "map<" not in t]
    return F.struct(*order_by, F.xxhash64(*hashable) if hashable else F.lit(0))


def dedup_latest(df: DataFrame, key: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """One row per key: the greatest by ``order_by`` (NULLs least), remaining ties by a hash of the row.

    An aggregate, not a window: copies of a key are combined before the shuffle, so no task ever sorts all
    rows of a hot key.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    latest = F.max_by(F.struct(*rest), latest_order(df, order_by, rest))
    return df.groupBy(*key).agg(latest.alias("__latest")).select(*key, "__latest.*").select(df.columns)
