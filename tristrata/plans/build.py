"""Running a model: staged tables, dimensions, facts, bridges and aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tristrata.functions.columns import update_stamp
from tristrata.operators.dimensions import (
    bridge_sources, build_bridge, build_dimension_scd1, build_dimension_scd2, dimension_key_columns,
)
from tristrata.operators.facts import build_fact, effective_date, fact_date, fact_key_columns
from tristrata.operators.gold import build_gold
from tristrata.operators.quality import run_checks
from tristrata.operators.scd import snapshot_check, snapshot_timestamp
from tristrata.operators.staging import stage
from tristrata.plans.specs import DimensionSpec, ModelSpec, TableSpec, unique_names
from tristrata.sources.incremental import (
    DEFAULT_LOOKBACK_DAYS, has_rows, incremental_filter, merge_months, newest_date, read_fact, refresh_gold,
)
from tristrata.sources.tables import advance_snapshot, layer_path, publish_view, read_snapshot, write_table


@dataclass
class Built:
    """Tables of a model by name, lazy or stored, and what the checks need to know about them."""

    sources: dict[str, DataFrame]
    model: ModelSpec
    effective_dates: dict[str, str | None]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def checks(self, as_of: datetime | str | None = None) -> DataFrame:
        return run_checks(self.sources, self.tables, self.model, self.effective_dates, as_of)


def _prepare(sources: Mapping[str, DataFrame], model: ModelSpec) -> Built:
    staged = {name: stage(df) for name, df in sources.items()}
    model = replace(model, gold=unique_names(model.gold))
    dates = {f.name: effective_date(staged, f, model.tables.get(f.source, TableSpec())) for f in model.facts}
    return Built(staged, model, dates)


def _next_snapshot(previous: DataFrame | None, source: DataFrame, spec: DimensionSpec, table: TableSpec, run_at):
    key = dimension_key_columns(source, spec, table)
    stamp = update_stamp(source)
    unique = bool(table.primary_key)
    if stamp:
        return snapshot_timestamp(previous, source, key, stamp, run_at, unique=unique)
    return snapshot_check(previous, source, key, run_at, unique=unique)


def build_model(sources: Mapping[str, DataFrame], model: ModelSpec, run_at: datetime | str) -> Built:
    """Every table of the model as a lazy DataFrame; nothing is written.

    SCD2 dimensions hold the versions opened at ``run_at`` (or at the source's update stamp).
    """
    built = _prepare(sources, model)
    for spec in model.dimensions:
        source, table = built.sources[spec.source], model.tables.get(spec.source, TableSpec())
        if spec.scd_type == 2:
            snapshot = _next_snapshot(None, source, spec, table, run_at)
            built.tables[spec.name] = build_dimension_scd2(snapshot, spec, table)
        else:
            built.tables[spec.name] = build_dimension_scd1(source, spec, table)
    for spec in model.facts:
        built.tables[spec.name] = build_fact(built.sources, spec, model.tables)
    for name in bridge_sources(built.sources, model):
        built.tables[f"bridge_{name}"] = build_bridge(built.sources[name])
    for spec in built.model.gold:
        fact = model.fact(spec.fact)
        built.tables[spec.name] = build_gold(
            built.tables[spec.fact], spec, fact.measure_names, built.effective_dates[spec.fact])
    return built


def read_dimension(spark: SparkSession, root: str, spec: DimensionSpec, table: TableSpec) -> DataFrame:
    """An SCD2 dimension of a stored model: a view of its snapshot, so that a run rewrites no history."""
    history = read_snapshot(spark, layer_path(root, "snapshots", f"snap_{spec.source}"))
    return build_dimension_scd2(history, spec, table)


def run_model(
    spark: SparkSession, sources: Mapping[str, DataFrame], model: ModelSpec, root: str, run_at: datetime | str,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
) -> Built:
    """Advance the stored model below ``root`` by one run.

    Snapshots add what changed and SCD2 dimensions are views of them; dated facts are upserted over the lookback window, aggregates on the fact's
    date are rebuilt for the months that changed; other tables are refreshed. Each step starts from stored
    tables, so a fact is computed once however many aggregates read it. A declared primary key is trusted to be
    unique; of rows that share a ``natural_key`` one is stored.
    """
    built = _prepare(sources, model)
    for name, df in built.sources.items():
        publish_view(df, model.tables.get(name, TableSpec()).layer, name)
    for spec in model.dimensions:
        source, table = built.sources[spec.source], model.tables.get(spec.source, TableSpec())
        target = layer_path(root, "silver", spec.name)
        if spec.scd_type == 2:
            path = layer_path(root, "snapshots", f"snap_{spec.source}")
            advance_snapshot(spark, path, partial(_next_snapshot, source=source, spec=spec, table=table, run_at=run_at))
            built.tables[spec.name] = read_dimension(spark, root, spec, table)
        else:
            built.tables[spec.name] = write_table(build_dimension_scd1(source, spec, table), target)
    months = {}
    for spec in model.facts:
        fact, path = build_fact(built.sources, spec, model.tables), layer_path(root, "silver", spec.name)
        date = built.effective_dates[spec.name]
        if date is None:
            built.tables[spec.name] = write_table(fact, path)
            continue
        recent = incremental_filter(fact, date, newest_date(spark, path, date), lookback_days)
        own_date, table = fact_date(built.sources[spec.source], spec.date), model.tables.get(spec.source, TableSpec())
        months[spec.name] = merge_months(
            recent, path, spec.key_column, date, key_has_date=date in fact_key_columns(spec, table, own_date),
            unique=bool(table.primary_key) and not spec.natural_key)
        built.tables[spec.name] = read_fact(spark, path, otherwise=fact)
    for name in bridge_sources(built.sources, model):
        target = layer_path(root, "silver", f"bridge_{name}")
        built.tables[f"bridge_{name}"] = write_table(build_bridge(built.sources[name]), target)
    for spec in built.model.gold:
        fact, path = model.fact(spec.fact), layer_path(root, "gold", spec.name)
        own_date = built.effective_dates[spec.fact]
        by_months = own_date is not None and spec.date in (None, own_date)
        fact_path = layer_path(root, "silver", spec.fact)
        if by_months and has_rows(spark, fact_path):
            built.tables[spec.name] = refresh_gold(spark, fact_path, path, spec, own_date, fact.measure_names,
                                                   months[spec.fact])
        else:
            gold = build_gold(built.tables[spec.fact], spec, fact.measure_names, own_date)
            # The aggregate of a fact without rows has none either: its month folders come with the first.
            built.tables[spec.name] = gold if by_months else write_table(gold, path)
    return built
