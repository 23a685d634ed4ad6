"""Comparing two versions of a table by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tristrata.functions.columns import check_columns, require


def pair_versions(
    old: DataFrame, new: DataFrame, key: Sequence[str], old_columns: Sequence[str], new_columns: Sequence[str]
) -> DataFrame:
    """Full outer join on the key: key columns, then both rows as the structs ``old`` and ``new``.

    A struct is NULL where its side has no such key. A NULL key equals a NULL key.
    """
    left = old.select(*(F.col(k).alias(f"__o_{k}") for k in key), F.struct(*old_columns).alias("old"))
    right = new.select(*(F.col(k).alias(f"__n_{k}") for k in key), F.struct(*new_columns).alias("new"))
    same = [F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}")) for k in key]
    pairs = left.join(right, reduce(Column.__and__, same), "full_outer")
    return pairs.select(*(F.coalesce(f"__o_{k}", f"__n_{k}").alias(k) for k in key), "old", "new")


def table_diff(
    old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
    include_unchanged: bool = False,
) -> DataFrame:
    """Key, ``change_type`` (added, removed, changed, unchanged), ``old`` and ``new`` rows as structs.

    ``columns`` limits the comparison; by default the business columns are compared. Comparison is
    null-safe. The key must be unique on both sides.
    """
    columns = list(columns or check_columns(new, list(key)))
    require(old, [*key, *columns], "table_diff, old side")
    require(new, [*key, *columns], "table_diff, new side")
    pairs = pair_versions(old, new, key, columns, columns)
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
               .when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged"))
    diff = pairs.select(*key, change.alias("change_type"), "old", "new")
    return diff if include_unchanged else diff.filter("change_type <> 'unchanged'")


def change_rate(
    old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row: keys in both versions, how many changed, added, removed, and the share changed."""
    diff = table_diff(old, new, key, columns, include_unchanged=True)

    def count(kind: str):
        return F.count_if(F.col("change_type") == kind)

    shared = count("changed") + count("unchanged")
    return diff.agg(
        shared.alias("shared_keys"), count("changed").alias("changed_keys"), count("added").alias("added_keys"),
        count("removed").alias("removed_keys"),
        (count("changed") / F.nullif(shared, F.lit(0))).alias("change_rate"),
    )
