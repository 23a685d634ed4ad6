"""Silver dimensions and bridges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tristrata.functions.columns import require
from tristrata.functions.keys import surrogate_key
from tristrata.plans.specs import DimensionSpec, ModelSpec, TableSpec


def dimension_key_columns(df: DataFrame, spec: DimensionSpec, table: TableSpec) -> list[str]:
    """Primary key, else all foreign key columns, else the first listed column."""
    return list(table.primary_key) or table.fk_columns or list(spec.columns or df.columns)[:1]


def _dimension_columns(df: DataFrame, spec: DimensionSpec) -> list[str]:
    columns = list(dict.fromkeys(spec.columns)) or df.columns
    require(df, columns, spec.name)
    return columns


def build_dimension_scd1(df: DataFrame, spec: DimensionSpec, table: TableSpec) -> DataFrame:
    """``<dim>_sk`` and the listed columns (all when none are), current state only.

    A projection without a shuffle; duplicates of a key are kept and reported by ``check_unique``.
    """
    key = dimension_key_columns(df, spec, table)
    columns = _dimension_columns(df, spec)
    return df.select(surrogate_key(key).alias(f"{spec.name}_sk"), *columns)


def build_dimension_scd2(snapshot: DataFrame, spec: DimensionSpec, table: TableSpec) -> DataFrame:
    """All versions of a snapshot: ``<dim>_sk`` over key and ``valid_from``, columns, validity, ``is_current``."""
    source = snapshot.drop("valid_from", "valid_to")
    key = dimension_key_columns(source, spec, table)
    columns = _dimension_columns(source, spec)
    return snapshot.select(
        surrogate_key([*key, "valid_from"]).alias(f"{spec.name}_sk"), *columns,
        "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"),
    )


def is_bridge(df: DataFrame, table: TableSpec) -> bool:
    """At least two foreign key columns, and nothing but key columns."""
    links = set(table.fk_columns)
    return len(links) >= 2 and set(df.columns) - set(table.primary_key) <= links


def bridge_sources(sources: Mapping[str, DataFrame], model: ModelSpec) -> list[str]:
    """Tables that link others and are modelled neither as dimension nor as fact."""
    modelled = {d.source for d in model.dimensions} | {f.source for f in model.facts}
    return [n for n, df in sources.items()
            if n not in modelled and is_bridge(df, model.tables.get(n, TableSpec()))]


def build_bridge(df: DataFrame) -> DataFrame:
    """All columns, in name order."""
    return df.select(*sorted(df.columns))


def bridge_join(
    left: DataFrame, bridge: DataFrame, right: DataFrame,
    left_on: Sequence[tuple[str, str]], right_on: Sequence[tuple[str, str]],
) -> DataFrame:
    """Resolve a many-to-many relationship: one row per bridge row whose two sides exist.

    ``left_on`` pairs columns of ``left`` with columns of the bridge, ``right_on`` columns of ``right``.
    The bridge's own key columns are kept once, under the sides' names.
    """
    links = {b: f"__b_{b}" for _, b in [*left_on, *right_on]}
    bridge = bridge.withColumnsRenamed(links)
    to_left = [F.col(a) == F.col(links[b]) for a, b in left_on]
    to_right = [F.col(a) == F.col(links[b]) for a, b in right_on]
    return bridge.join(left, to_left).join(right, to_right).drop(*links.values())
