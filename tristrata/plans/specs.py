"""Specifications: what to build, as plain immutable values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

AGGREGATIONS = ("SUM", "COUNT", "COUNT_DISTINCT", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of one table refer to ``parent_columns`` of ``parent``; composite keys keep all columns."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """Keys of one source table, declared by the user or found by profiling."""

    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    loaded_at: str | None = None
    layer: str = "public"

    @property
    def fk_columns(self) -> list[str]:
        return list(dict.fromkeys(c for fk in self.foreign_keys for c in fk.columns))


@dataclass(frozen=True)
class DimensionSpec:
    name: str
    source: str
    scd_type: int = 1
    columns: tuple[str, ...] = ()
    grain: str = ""


@dataclass(frozen=True)
class Derived:
    """A measure computed from the fact's own columns with a Spark SQL expression."""

    name: str
    expression: str


@dataclass(frozen=True)
class KeyPath:
    """A key reached through a foreign key: ``column`` of ``fk.parent``, carried as ``alias``."""

    fk: ForeignKey
    column: str
    alias: str


@dataclass(frozen=True)
class FactSpec:
    """``date`` and ``extra_dates`` are chosen from the schema when None; ``natural_key`` overrides the
    surrogate key's columns. ``length_prefixed`` keys cannot collide, whatever text the columns hold, but differ from
    plain ones."""

    name: str
    source: str
    dimension_keys: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    derived: tuple[Derived, ...] = ()
    date: str | None = None
    key_paths: tuple[KeyPath, ...] = ()
    extra_dates: tuple[str, ...] | None = None
    natural_key: tuple[str, ...] = ()
    factless: bool = False
    grain: str = ""
    length_prefixed: bool = False

    @property
    def key_column(self) -> str:
        return f"{self.name}_sk"

    @property
    def measure_names(self) -> set[str]:
        return {*self.measures, *(d.name for d in self.derived)}


@dataclass(frozen=True)
class Metric:
    name: str
    aggregation: str
    column: str = "*"

    def __post_init__(self):
        if self.aggregation.upper() not in AGGREGATIONS:
            raise ValueError(f"metric {self.name}: unknown aggregation {self.aggregation!r}")
        object.__setattr__(self, "aggregation", self.aggregation.upper())


@dataclass(frozen=True)
class GoldSpec:
    name: str
    fact: str
    grain: str = "daily"
    dimensions: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    date: str | None = None
    description: str = ""


@dataclass(frozen=True)
class ModelSpec:
    """A whole medallion model: staged tables, dimensions, facts, aggregates."""

    tables: Mapping[str, TableSpec]
    dimensions: tuple[DimensionSpec, ...] = ()
    facts: tuple[FactSpec, ...] = ()
    gold: tuple[GoldSpec, ...] = ()

    def fact(self, name: str) -> FactSpec:
        return next(f for f in self.facts if f.name == name)


@dataclass(frozen=True)
class Entity:
    """A key on a fact; a foreign entity names the dimension its attributes come from."""

    name: str
    column: str
    kind: str = "foreign"
    dimension: str | None = None
    dimension_key: str | None = None


@dataclass(frozen=True)
class TimeDimension:
    name: str
    column: str
    granularity: str = "day"


@dataclass(frozen=True)
class Measure:
    name: str
    aggregation: str
    expression: str = "*"


@dataclass(frozen=True)
class SemanticModel:
    """Entities, dimensions and measures of one fact."""

    name: str
    fact: str
    measures: tuple[Measure, ...]
    time: TimeDimension | None = None
    entities: tuple[Entity, ...] = ()
    categorical: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class BusinessMetric:
    """``simple`` and ``cumulative`` name a measure, ``ratio`` two, ``derived`` an expression over metrics."""

    name: str
    kind: str
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expression: str | None = None
    inputs: tuple[str, ...] = ()

    def __post_init__(self):
        needed = {
            "simple": (self.measure,), "cumulative": (self.measure,),
            "ratio": (self.numerator, self.denominator), "derived": (self.expression, self.inputs),
        }
        if self.kind not in needed:
            raise ValueError(f"metric {self.name}: unknown kind {self.kind!r}")
        if not all(needed[self.kind]):
            raise ValueError(f"metric {self.name}: a {self.kind} metric lacks its parameters")


def unique_names(specs: tuple[GoldSpec, ...]) -> tuple[GoldSpec, ...]:
    """Give aggregates of the same name distinct output names by inserting their fact's short name.

    ``agg_daily_volume`` of ``fct_orders`` becomes ``agg_daily_orders_volume``.
    """
    taken = [s.name for s in specs]
    renamed = []
    for spec in specs:
        if taken.count(spec.name) > 1:
            short = spec.fact.removeprefix("fct_")
            head, grain, tail = (spec.name.split("_", 2) + ["", ""])[:3]
            fits = head == "agg" and tail
            spec = replace(spec, name=f"{head}_{grain}_{short}_{tail}" if fits else f"{spec.name}_{short}")
        renamed.append(spec)
    names = [s.name for s in renamed]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"aggregates would overwrite each other: {', '.join(clashes)}")
    return tuple(renamed)
