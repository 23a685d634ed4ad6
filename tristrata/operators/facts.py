"""Silver facts: one row per source row, enriched through foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tristrata.functions.columns import date_columns, require
from tristrata.functions.keys import surrogate_key
from tristrata.functions.scalars import guard_division
from tristrata.plans.specs import Derived, FactSpec, ForeignKey, KeyPath, TableSpec


def derived_measures(df: DataFrame, derived: Sequence[Derived]) -> dict[str, Column]:
    """Name → expression, division guarded; a formula that repeats an earlier one is dropped.

    Whether two formulas are the same is Spark's judgement (``a * b`` equals ``b * a``). An expression that
    uses a column ``df`` lacks raises.
    """
    kept: dict[str, tuple[Column, DataFrame]] = {}
    for measure in derived:
        column = F.expr(guard_division(measure.expression))
        result = df.select(column.alias("value"))
        if not any(result.sameSemantics(other) for _, other in kept.values()):
            kept[measure.name] = column, result
    return {name: column for name, (column, _) in kept.items()}


def fact_date(df: DataFrame, declared: str | None) -> str | None:
    """The declared date if the table has it, else its first business date, else its first audit stamp."""
    if declared and declared in df.columns:
        return declared
    return next(iter(date_columns(df)), None)


def parent_date(sources: Mapping[str, DataFrame], table: TableSpec) -> KeyPath | None:
    """For a fact without a date: the date of the first foreign key's parent that has one."""
    for fk in table.foreign_keys:
        if fk.parent in sources:
            dates = date_columns(sources[fk.parent])
            if dates:
                return KeyPath(fk, dates[0], f"{fk.parent}_{dates[0]}")
    return None


def effective_date(sources: Mapping[str, DataFrame], spec: FactSpec, table: TableSpec) -> str | None:
    """Name of the date column the built fact carries, own or from a parent."""
    own = fact_date(sources[spec.source], spec.date)
    if own:
        return own
    path = parent_date(sources, table)
    return path.alias if path else None


def fact_key_columns(spec: FactSpec, table: TableSpec, date: str | None) -> list[str]:
    """Columns the surrogate key hashes: the primary key (else the first dimension key).

    The date joins in for periodic snapshots (the date is a dimension key) and for junctions (every key
    column is a foreign key, so the same pair can recur on other dates).
    """
    if spec.natural_key:
        return list(spec.natural_key)
    key = list(table.primary_key or spec.dimension_keys[:1])
    if not key:
        raise ValueError(f"{spec.name}: no primary key, dimension key or natural_key to identify its rows")
    if date and date not in key:
        periodic = date in spec.dimension_keys
        junction = set(key) <= set(table.fk_columns)
        if periodic or junction:
            key.append(date)
    return key


def build_fact(
    sources: Mapping[str, DataFrame], spec: FactSpec, tables: Mapping[str, TableSpec]
) -> DataFrame:
    """Surrogate key, dimension keys, rest of the primary key, date, measures, derived measures, keys reached
    through foreign keys, further event dates; a name that occurs twice is kept at its first place.

    Parents are LEFT-joined once per foreign key, so no row is lost, and none is added while parent keys are
    unique. Parent columns come under reserved names, so expressions see only the fact's own columns.
    """
    source, table = sources[spec.source], tables.get(spec.source, TableSpec())
    own_date = fact_date(source, spec.date)
    injected = None if own_date else parent_date(sources, table)
    extra = spec.extra_dates
    if extra is None:
        extra = [d for d in date_columns(source, audit=False) if d != own_date]
    require(source, [*spec.dimension_keys, *spec.measures, *extra], spec.name)

    keys = fact_key_columns(spec, table, own_date)
    require(source, keys, f"{spec.name} key")
    paths = list(spec.key_paths) + ([injected] if injected else [])
    joined, carried = join_parents(source, sources, paths)

    output: dict[str, Column] = {}
    for name in [*spec.dimension_keys, *(k for k in table.primary_key if k not in spec.dimension_keys)]:
        output.setdefault(name, F.col(name))
    if own_date:
        output.setdefault(own_date, F.col(own_date))
    elif injected:
        output.setdefault(injected.alias, carried[injected])
    for name in spec.measures:
        output.setdefault(name, F.col(name))
    for name, column in derived_measures(source, spec.derived).items():
        output.setdefault(name, column)
    for path in spec.key_paths:
        output.setdefault(path.alias, carried[path])
    for name in extra:
        output.setdefault(name, F.col(name))
    return joined.select(
        surrogate_key(keys, spec.length_prefixed).alias(spec.key_column), *(c.alias(n) for n, c in output.items())
    )


def join_parents(
    df: DataFrame, sources: Mapping[str, DataFrame], paths: Sequence[KeyPath]
) -> tuple[DataFrame, dict[KeyPath, Column]]:
    """LEFT JOIN the parent of every path, one join per foreign key however many columns it carries.

    A parent is never assumed small: Spark broadcasts it when its measured size allows and otherwise
    sort-merges, splitting the partitions of hot foreign key values.
    """
    by_fk: dict[ForeignKey, list[KeyPath]] = {}
    for path in paths:
        by_fk.setdefault(path.fk, []).append(path)
    carried: dict[KeyPath, Column] = {}
    for i, (fk, group) in enumerate(by_fk.items()):
        parent = sources[fk.parent]
        require(parent, [*fk.parent_columns, *(p.column for p in group)], f"join to {fk.parent}")
        names = {c: f"__p{i}_{c}" for c in dict.fromkeys([*fk.parent_columns, *(p.column for p in group)])}
        renamed = parent.select(*(F.col(c).alias(n) for c, n in names.items()))
        condition = [F.col(c) == F.col(names[pc]) for c, pc in zip(fk.columns, fk.parent_columns, strict=True)]
        df = df.join(renamed, condition, "left")
        carried.update({p: F.col(names[p.column]) for p in group})
    return df, carried
