"""Data-quality checks. Every check returns rows ``model, check, columns, failures, status``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tristrata.functions.columns import require, update_stamp
from tristrata.operators.gold import resolve_gold
from tristrata.plans.specs import ModelSpec, TableSpec

RESULT = ("model", "check", "columns", "failures", "status")

# A source is late after the first and failed after the second number of hours.
WARN_HOURS, ERROR_HOURS = 24, 48


def _result(model: str, check: str, columns: str | Column, failures: Column, status: Column | None = None):
    failures = F.coalesce(failures, F.lit(0)).cast("bigint")
    status = F.when(failures == 0, "pass").otherwise("fail") if status is None else status
    return [F.lit(model).alias("model"), F.lit(check).alias("check"),
            (F.lit(columns) if isinstance(columns, str) else columns).alias("columns"),
            failures.alias("failures"), status.alias("status")]


def check_unique(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """Number of keys that occur more than once; rows whose key columns are all NULL do not count."""
    present = reduce(Column.__or__, (F.col(c).isNotNull() for c in columns))
    repeated = df.filter(present).groupBy(*columns).count().filter("count > 1")
    return repeated.agg(F.count(F.lit(1)).alias("n")).select(*_result(model, "unique", ", ".join(columns), F.col("n")))


def check_not_null(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    """Number of NULLs per column, one row each, from a single pass."""
    require(df, columns, f"check_not_null of {model}")
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns))
    rows = counts.select(F.explode(pairs).alias("row"))
    return rows.select(*_result(model, "not_null", F.col("row.name"), F.col("row.n")))


def check_relationships(
    df: DataFrame, model: str, columns: Sequence[str], dimension: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Number of rows whose foreign key has no match; a key with a NULL part passes.

    Rows are counted per key before the join, so a hot key travels as one row.
    """
    present = reduce(Column.__and__, (F.col(c).isNotNull() for c in columns))
    used = df.filter(present).groupBy(*(F.col(c).alias(f"__f_{c}") for c in columns)).count()
    on = [F.col(f"__f_{c}") == F.col(f"__d_{k}") for c, k in zip(columns, key, strict=True)]
    keys = dimension.select(*(F.col(k).alias(f"__d_{k}") for k in key))
    orphans = used.join(keys, reduce(Column.__and__, on), "left_anti").agg(F.sum("count").alias("n"))
    return orphans.select(*_result(model, "relationships", ", ".join(columns), F.col("n")))


def check_freshness(
    df: DataFrame, model: str, loaded_at: str, as_of: datetime | str | None = None,
    warn_hours: int = WARN_HOURS, error_hours: int = ERROR_HOURS,
) -> DataFrame:
    """Age of the newest load: above ``warn_hours`` warn, above ``error_hours`` (or nothing loaded) error."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    newest = df.agg(F.max(F.col(loaded_at).cast("timestamp_ntz")).alias("newest"))
    seconds = F.timestamp_diff("SECOND", F.col("newest"), now.cast("timestamp_ntz"))
    status = (F.when(F.col("newest").isNull() | (seconds > error_hours * 3600), "error")
               .when(seconds > warn_hours * 3600, "warn").otherwise("pass"))
    return newest.select(*_result(model, "freshness", loaded_at, (status != "pass").cast("int"), status))


@dataclass(frozen=True)
class _Check:
    """One check of a table; its rows are counted by ``number`` in the table's pass."""

    check: str
    columns: tuple[str, ...]
    dimension: str | None = None
    key: tuple[str, ...] = ()


def check_table(df: DataFrame, model: str, unique: Sequence[Sequence[str]] = (), not_null: Sequence[str] = (),
                relationships: Sequence[tuple[Sequence[str], str, Sequence[str]]] = (), dimensions: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All uniqueness, NULL and reference checks of a table from one scan of it.

    Every row gives a number and a 128-bit hash for each of the checks it takes part in; they are counted map-side, meet
    the keys of the ``dimensions``, each of which is scanned once, and one aggregate tells how many keys repeat, how many
    values are NULL and how many rows have no match. Hashes of equal values are equal, of others about never.
    """
    require(df, [*not_null, *(c for u in unique for c in u), *(c for r in relationships for c in r[0])], f"checks of {model}")
    checks = [_Check("unique", tuple(u)) for u in unique] + [_Check("not_null", (c,)) for c in not_null]
    checks += [_Check("relationships", tuple(columns), dimension, tuple(key)) for columns, dimension, key in relationships]

    def cell(i: int, check: _Check) -> Column:
        columns = [F.col(c) for c in check.columns]
        if check.check == "not_null":
            return F.when(columns[0].isNull(), F.struct(F.lit(i).alias("i"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
        present = (c.isNotNull() for c in columns)
        taking = reduce(Column.__or__ if check.check == "unique" else Column.__and__, present)
        if check.check == "unique":  # hashes skip NULLs, so which parts are NULL is hashed, too
            columns += [c.isNull() for c in columns]
        else:
            columns = [c.cast(_wide(dimensions[check.dimension].schema[k].dataType)) for c, k in zip(columns, check.key, strict=True)]
        return F.when(taking, F.struct(F.lit(i).alias("i"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b")))

    cells = df.select(F.explode(F.array(*(cell(i, c) for i, c in enumerate(checks)))).alias("cell")).filter("cell is not null").select("cell.*")
    counted = cells.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    keyed = [(i, c) for i, c in enumerate(checks) if c.check == "relationships"]
    if keyed:
        known = reduce(DataFrame.unionByName, (_known(dimensions[d], [(i, c) for i, c in keyed if c.dimension == d]) for d in dict.fromkeys(c.dimension for _, c in keyed)))
        both = counted.withColumn("known", F.lit(False)).unionByName(known)
        counted = both.groupBy("i", "a", "b").agg(F.sum("n").alias("n"), F.bool_or("known").alias("known"))
    else:
        counted = counted.withColumn("known", F.lit(False))
    number = F.col("i").cast("int")
    kind = F.element_at(F.array(*(F.lit(c.check) for c in checks)), number + 1)
    failing = F.when(kind == "unique", (F.col("n") > 1).cast("bigint")).when(kind == "not_null", F.col("n")).otherwise(F.when(~F.col("known"), F.col("n")).otherwise(0))
    failures = counted.groupBy("i").agg(F.sum(failing).alias("failures"))
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*(F.struct(F.lit(c.check).alias("check"), F.lit(", ".join(c.columns)).alias("columns")) for c in checks))).alias("i", "c"))
    found = listed.join(failures, "i", "left")
    total = F.coalesce("failures", F.lit(0)).cast("bigint")
    return found.select(F.lit(model).alias("model"), "c.check", "c.columns", total.alias("failures"), F.when(total == 0, "pass").otherwise("fail").alias("status"))


def _wide(kind: T.DataType) -> T.DataType:
    """The type in which keys of both sides are hashed: integers as one, others as they are in the dimension."""
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def _known(dimension: DataFrame, checks: Sequence[tuple[int, _Check]]) -> DataFrame:
    """The keys of a dimension as cells of the checks that refer to it, from one scan."""
    def cell(i: int, check: _Check) -> Column:
        columns = [F.col(k).cast(_wide(dimension.schema[k].dataType)) for k in check.key]
        return F.struct(F.lit(i).alias("i"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))

    cells = dimension.select(F.explode(F.array(*(cell(i, c) for i, c in checks))).alias("cell")).select("cell.*").distinct()
    return cells.select("i", "a", "b", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("known"))


def run_checks(
    sources: Mapping[str, DataFrame], built: Mapping[str, DataFrame], model: ModelSpec,
    effective_dates: Mapping[str, str | None], as_of: datetime | str | None = None,
) -> DataFrame:
    """All checks a model implies, in one result table; each table is scanned once, and dimensions once more for each
    fact that refers to them.

    Surrogate keys are unique and present; dimension keys and dates are present where the source says NOT
    NULL; foreign keys have their dimension row; aggregates are unique by date and dimensions; sources with a
    load stamp are fresh.
    """
    checks = []
    for name, table in model.tables.items():
        stamp = table.loaded_at or (update_stamp(sources[name]) if name in sources else None)
        if stamp:
            checks.append(check_freshness(sources[name], name, stamp, as_of))
    for dim in model.dimensions:
        if dim.name in built:
            key = f"{dim.name}_sk"
            checks.append(check_table(built[dim.name], dim.name, [[key]], [key]))
    by_source = {d.source: d.name for d in model.dimensions}
    for fact in model.facts:
        df, table = built[fact.name], model.tables.get(fact.source, TableSpec())
        required = [c for c in [*fact.dimension_keys, effective_dates.get(fact.name)] if c in table.not_null]
        links = [(fk.columns, by_source[fk.parent], fk.parent_columns) for fk in table.foreign_keys
                 if by_source.get(fk.parent) in built and set(fk.columns) <= set(df.columns)]
        checks.append(check_table(df, fact.name, [[fact.key_column]], list(dict.fromkeys([fact.key_column, *required])), links, built))
    for spec in model.gold:
        fact = model.fact(spec.fact)
        settled = resolve_gold(built[spec.fact], spec, fact.measure_names, effective_dates.get(spec.fact))
        key = ([f"{settled.grain}_date"] if settled.date else []) + list(spec.dimensions)
        if key:
            checks.append(check_table(built[spec.name], spec.name, [key], key[:1] if settled.date else []))
    return reduce(DataFrame.unionByName, checks)
