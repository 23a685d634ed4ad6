"""Business metrics over the measures of a fact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tristrata.functions.columns import require
from tristrata.functions.scalars import guard_division, safe_divide, to_grain
from tristrata.operators.periods import cumulative
from tristrata.operators.star import DimensionLink, star_aggregate
from tristrata.plans.specs import BusinessMetric, Metric, SemanticModel


def query_metric(
    models: Mapping[str, DataFrame], model: SemanticModel, metrics: Mapping[str, BusinessMetric],
    names: Sequence[str], grain: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Metrics by period and dimensions, in one pass over the fact.

    ``by`` takes categorical dimensions, entities (the key itself) and ``entity__attribute`` for an attribute
    of the entity's dimension. ``grain`` None leaves time out; ``"default"`` takes the time dimension's own.
    Ratios divide aggregates, never average row ratios. Attributes are joined after aggregating to keys.
    """
    fact = models[model.fact]
    wanted = [_known(metrics, n) for n in names]
    measures = _measures_of(wanted, metrics)

    fact, groups, links = _group_columns(models, model, fact, by)
    date = None
    if grain is not None:
        if model.time is None:
            raise ValueError(f"{model.name} has no time dimension")
        grain = model.time.granularity if grain == "default" else grain
        date = f"{grain}_date"
        groups = [to_grain(model.time.column, grain).alias(date), *groups]

    by_name = {m.name: m for m in model.measures}
    missing = [m for m in measures if m not in by_name]
    if missing:
        raise ValueError(f"{model.name}: unknown measure(s) {', '.join(missing)}")
    inputs = {f"__in_{m}": F.expr(guard_division(by_name[m].expression))
              for m in measures if by_name[m].expression != "*"}
    aggregates = [Metric(m, by_name[m].aggregation.upper(),
                         "*" if by_name[m].expression == "*" else f"__in_{m}") for m in measures]
    result = star_aggregate(fact.withColumns(inputs), links, groups, aggregates)

    keys = [c for c in result.columns if c not in measures]
    dimensions = [k for k in keys if k != date]
    result = result.withColumnsRenamed({m: f"__ms_{m}" for m in measures})
    for metric in _in_order(wanted, metrics):
        result = _add(result, metric, date, dimensions)
    return result.select(*keys, *names)


def _known(metrics: Mapping[str, BusinessMetric], name: str) -> BusinessMetric:
    if name not in metrics:
        raise ValueError(f"unknown metric {name!r}; have {', '.join(metrics)}")
    return metrics[name]


def _in_order(
    wanted: Sequence[BusinessMetric], metrics: Mapping[str, BusinessMetric], above: tuple[str, ...] = ()
) -> list[BusinessMetric]:
    """The wanted metrics and all they are derived from, inputs first."""
    ordered: dict[str, BusinessMetric] = {}
    for metric in wanted:
        if metric.name in above:
            raise ValueError(f"metric {metric.name} is derived from itself")
        inputs = [_known(metrics, n) for n in metric.inputs]
        for needed in [*_in_order(inputs, metrics, (*above, metric.name)), metric]:
            ordered.setdefault(needed.name, needed)
    return list(ordered.values())


def _measures_of(wanted: Sequence[BusinessMetric], metrics: Mapping[str, BusinessMetric]) -> list[str]:
    used = [name for m in _in_order(wanted, metrics) for name in (m.measure, m.numerator, m.denominator) if name]
    return list(dict.fromkeys(used))


def _group_columns(models, model: SemanticModel, fact: DataFrame, by: Sequence[str]):
    """The fact with its grouping columns under their public names, those names, and the joins they need."""
    entities = {e.name: e for e in model.entities}
    groups, attributes = [], {}
    for item in by:
        name, _, attribute = item.partition("__")
        if item in model.categorical:
            groups.append(F.expr(model.categorical[item]).alias(item))
        elif item in entities:
            groups.append(F.col(entities[item].column).alias(item))
        elif name in entities and attribute:
            if not entities[name].dimension:
                raise ValueError(f"entity {name} names no dimension to take {attribute} from")
            attributes.setdefault(name, {})[item] = attribute
            groups.append(item)
        else:
            raise ValueError(f"{model.name}: unknown dimension {item!r}")
    links = []
    for name, columns in attributes.items():
        entity, dimension = entities[name], models[entities[name].dimension]
        if "is_current" in dimension.columns:
            dimension = dimension.filter("is_current")
        key = entity.dimension_key or entity.column
        require(dimension, [key, *columns.values()], f"dimension of {name}")
        links.append(DimensionLink(dimension, (entity.column,), (key,), columns))
    return fact, groups, links


def _add(result: DataFrame, metric: BusinessMetric, date: str | None, dimensions: Sequence[str]) -> DataFrame:
    if metric.kind == "simple":
        return result.withColumn(metric.name, F.col(f"__ms_{metric.measure}"))
    if metric.kind == "ratio":
        ratio = safe_divide(f"__ms_{metric.numerator}", f"__ms_{metric.denominator}")
        return result.withColumn(metric.name, ratio)
    if metric.kind == "derived":
        return result.withColumn(metric.name, F.expr(guard_division(metric.expression)))
    if date is None:
        raise ValueError(f"metric {metric.name}: a cumulative metric needs a grain")
    return cumulative(result, f"__ms_{metric.measure}", date, dimensions, metric.name)
