"""Gold: aggregates of a fact by time grain and dimensions."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tristrata.functions.columns import require
from tristrata.functions.scalars import to_grain
from tristrata.plans.specs import GoldSpec, Metric


def aggregate(metric: Metric, measures: Collection[str] = (), approx: bool = False) -> Column:
    """The aggregate column of a metric, under its name.

    COUNT of a measure counts rows, NULL measures included; COUNT of any other column skips NULLs.
    ``approx`` replaces the exact distinct count by a sketch of fixed size.
    """
    kind, name = metric.aggregation, metric.column
    if kind == "COUNT" and (name == "*" or name in measures):
        result = F.count(F.lit(1))
    elif kind == "COUNT_DISTINCT":
        result = F.approx_count_distinct(name) if approx else F.count_distinct(F.col(name))
    else:
        function = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[kind]
        result = function(F.col(name))
    return result.alias(metric.name)


def partial_states(fact: DataFrame, spec: GoldSpec, measures: Collection[str] = (), grain: str = "month") -> DataFrame:
    """What the aggregate needs to know of each ``grain`` and group, such that coarser grains can be merged from it.

    Columns ``__period``, dimensions, ``__metric`` and parts: a row of ``__metric`` -1 has the sums, counts and extremes of
    all metrics; for each metric that counts distinct values there is a row per value, as a 128-bit hash.
    """
    groups = [to_grain(spec.date, grain).alias("__period"), *(F.col(d) for d in spec.dimensions)]
    parts = []
    for i, m in enumerate(spec.metrics):
        if m.aggregation == "AVG":
            parts += [F.sum(F.col(m.column)).alias(f"__p{i}"), F.count(F.col(m.column)).alias(f"__n{i}")]
        elif m.aggregation != "COUNT_DISTINCT":
            parts.append(aggregate(replace(m, name=f"__p{i}"), measures))
    states = fact.groupBy(*groups).agg(F.lit(-1).alias("__metric"), *parts)
    for i, m in enumerate(spec.metrics):
        if m.aggregation == "COUNT_DISTINCT":
            value = [F.xxhash64(m.column).alias("__a"), F.xxhash64(F.lit(1), m.column).alias("__b")]
            seen = fact.filter(F.col(m.column).isNotNull()).select(*groups, F.lit(i).alias("__metric"), *value).distinct()
            states = states.unionByName(seen, allowMissingColumns=True)
    return states


def merge_states(states: DataFrame, spec: GoldSpec, schema: T.StructType) -> DataFrame:
    """The aggregate of ``spec``, with the columns of ``schema``, from the states of a finer grain."""
    def merged(i: int, m: Metric) -> Column:
        part = F.col(f"__p{i}")
        if m.aggregation == "COUNT_DISTINCT":
            return F.count_distinct(F.when(F.col("__metric") == i, F.struct("__a", "__b")))
        if m.aggregation == "AVG":
            return F.sum(part) / F.nullif(F.sum(f"__n{i}"), F.lit(0))
        return {"MIN": F.min, "MAX": F.max}.get(m.aggregation, F.sum)(part)

    period = f"{spec.grain}_date"
    metrics = [merged(i, m).cast(schema[m.name].dataType).alias(m.name) for i, m in enumerate(spec.metrics)]
    return states.groupBy(to_grain("__period", spec.grain).alias(period), *spec.dimensions).agg(*metrics)


def resolve_gold(
    fact: DataFrame, spec: GoldSpec, measures: Collection[str] = (), fact_date: str | None = None,
    on_unknown: str = "raise",
) -> GoldSpec:
    """Check a specification against the fact and settle its date and grain.

    ``on_unknown="single_measure"`` lets metrics fall back to the fact's measure when it has exactly one and every
    metric names an unknown column; expressions never fall back. A ``…_ytd`` aggregate of finer grain than a month becomes yearly.
    """
    date = spec.date or fact_date
    require(fact, [*spec.dimensions, *([date] if date else [])], spec.name)
    metrics = spec.metrics
    unknown = [m for m in metrics if m.column != "*" and m.column not in fact.columns]
    names = all(m.column.isidentifier() for m in unknown)
    if unknown and names and len(unknown) == len(metrics) and on_unknown == "single_measure":
        numeric = [f.name for f in fact.schema if f.name in measures and isinstance(f.dataType, T.NumericType)]
        if len(numeric) == 1:
            metrics = tuple(replace(m, column=numeric[0]) for m in metrics)
            unknown = []
    if unknown or not metrics:
        raise ValueError(
            f"{spec.name}: metrics need a column of the fact, expressions belong into derived measures; "
            f"got {', '.join(m.column for m in unknown) or 'no metric'}"
        )
    grain = spec.grain
    if spec.name.endswith("_ytd") and grain.lower() in ("daily", "day", "weekly", "week"):
        grain = "yearly"
    return replace(spec, date=date, metrics=metrics, grain=grain)


def build_gold(
    fact: DataFrame, spec: GoldSpec, measures: Collection[str] = (), fact_date: str | None = None,
    approx: bool = False, on_unknown: str = "raise",
) -> DataFrame:
    """``<grain>_date``, dimensions, metrics in specification order; rows without a date form their own group.

    Without a date the groups are the dimensions alone, without those too it is one global row. Rows are
    combined before the shuffle, so its size follows the number of groups and no group can be too hot.
    """
    spec = resolve_gold(fact, spec, measures, fact_date, on_unknown)
    groups = [F.col(d) for d in spec.dimensions]
    if spec.date:
        groups.insert(0, to_grain(spec.date, spec.grain).alias(f"{spec.grain}_date"))
    return fact.groupBy(*groups).agg(*(aggregate(m, measures, approx) for m in spec.metrics))
