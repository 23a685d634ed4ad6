"""Joining facts to dimensions and to each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tristrata.functions.columns import require
from tristrata.operators.dedup import dedup_latest
from tristrata.operators.gold import aggregate
from tristrata.operators.hotkeys import HOT_KEY_ROWS, bounds_of, hot_keys, in_pieces, with_ends, without_hot
from tristrata.plans.specs import Metric

# With at most this many versions per key, trying each on every fact row is cheaper than merging by time.
MAX_RANGE_VERSIONS = 64


@dataclass(frozen=True)
class DimensionLink:
    """``fact_columns`` of a fact refer to ``key`` of ``dimension``, of which ``attributes`` are wanted."""

    dimension: DataFrame
    fact_columns: tuple[str, ...]
    key: tuple[str, ...]
    attributes: Mapping[str, str]  # output name -> dimension column


def star_join(fact: DataFrame, links: Sequence[DimensionLink]) -> DataFrame:
    """Fact LEFT JOIN each dimension, facts without a match kept; links may chain along earlier attributes.

    Only requested attributes are read. Spark broadcasts a dimension when its size allows; else hot keys are
    split by the skew-join rule. An SCD2 dimension must be limited to its current rows or joined as-of.
    """
    for i, link in enumerate(links):
        require(link.dimension, [*link.key, *link.attributes.values()], "star_join")
        keys = [f"__d{i}_{n}" for n in range(len(link.key))]
        side = link.dimension.select(*(F.col(c).alias(k) for c, k in zip(link.key, keys)),
                                     *(F.col(c).alias(n) for n, c in link.attributes.items()))
        on = [F.col(c) == F.col(k) for c, k in zip(link.fact_columns, keys, strict=True)]
        fact = fact.join(side, on, "left").drop(*keys)
    return fact


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a DataFrame's size, from file sizes and the columns read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _broadcastable(df: DataFrame) -> bool:
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimated_bytes(df) <= limit


def star_aggregate(
    fact: DataFrame, links: Sequence[DimensionLink], groups: Sequence[str | Column], metrics: Sequence[Metric],
    measures: Sequence[str] = (),
) -> DataFrame:
    """Metrics of a fact grouped by attributes of its dimensions.

    Dimensions that Spark will broadcast are joined first, which moves no fact row. For the others the fact is
    reduced to one row per foreign key value and group before the join, so the join sees no hot key and
    shuffles keys instead of facts; partial results are then combined per attribute. Exact distinct counts
    keep their column as a further key of the reduced rows. Columns, their order and their types are the same
    whichever way a dimension is joined.
    """
    small, large, late = [], [], set()
    for link in links:
        side = link.dimension.select(*dict.fromkeys([*link.key, *link.attributes.values()]))
        if late.isdisjoint(link.fact_columns) and _broadcastable(side):
            small.append(link)
        else:
            large.append(link)
            late.update(link.attributes)
    fact = star_join(fact, small)
    direct = star_join(fact, large).groupBy(*groups).agg(*(aggregate(m, measures) for m in metrics))
    if not large:
        return direct
    reduced = _reduce_then_join(fact, large, late, groups, metrics, measures)
    return reduced.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in direct.schema))


def _reduce_then_join(
    fact: DataFrame, links: Sequence[DimensionLink], attributes: set[str], groups: Sequence[str | Column],
    metrics: Sequence[Metric], measures: Sequence[str],
) -> DataFrame:
    plain = [g for g in groups if not (isinstance(g, str) and g in attributes)]
    wanted = [g for g in groups if isinstance(g, str) and g in attributes]
    keys = list(dict.fromkeys(c for link in links for c in link.fact_columns if c not in attributes))
    distinct = dict.fromkeys(m.column for m in metrics if m.aggregation == "COUNT_DISTINCT")
    grouped = fact.groupBy(*plain, *(F.col(k).alias(f"__k_{k}") for k in keys),
                           *(F.col(c).alias(f"__v_{c}") for c in distinct))

    partial, final = [], []
    for m in metrics:
        name = f"__m_{m.name}"
        value = F.col(m.column) if m.column != "*" else F.lit(1)
        if m.aggregation == "COUNT_DISTINCT":
            final.append(F.count_distinct(f"__v_{m.column}").alias(m.name))
        elif m.aggregation == "COUNT":
            partial.append(aggregate(m, measures).alias(name))
            final.append(F.coalesce(F.sum(name), F.lit(0)).alias(m.name))
        elif m.aggregation == "AVG":
            partial += [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]
            final.append((F.sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0))).alias(m.name))
        else:
            partial.append(aggregate(m).alias(name))
            final.append({"SUM": F.sum, "MIN": F.min, "MAX": F.max}[m.aggregation](name).alias(m.name))
    reduced = grouped.agg(*(partial or [F.count(F.lit(1)).alias("__rows")]))
    kept = [c for c in reduced.columns if not c.startswith("__")]
    joined = star_join(reduced, [
        DimensionLink(k.dimension, tuple(f"__k_{c}" if c in keys else c for c in k.fact_columns), k.key, k.attributes)
        for k in links
    ])
    return joined.groupBy(*kept, *wanted).agg(*final)


def cross_fact(
    left: DataFrame, right: DataFrame, dimension: DataFrame, left_key: str, right_key: str, dimension_key: str,
    left_metrics: Sequence[Column], right_metrics: Sequence[Column], attributes: Sequence[str] = (),
) -> DataFrame:
    """Two facts side by side per shared dimension key: inner to the dimension, LEFT to the second fact.

    Each fact is aggregated to the key before joining, so rows of one do not multiply rows of the other.
    """
    first = left.groupBy(F.col(left_key).alias("__l")).agg(*left_metrics)
    second = right.groupBy(F.col(right_key).alias("__r")).agg(*right_metrics)
    shared = dimension.select(dimension_key, *attributes)
    return (first.join(shared, F.col("__l") == F.col(dimension_key))
                 .join(second, F.col(dimension_key) == F.col("__r"), "left")
                 .select(dimension_key, *attributes, *(c for c in first.columns if c != "__l"),
                         *(c for c in second.columns if c != "__r")))


def scd2_current_join(
    fact: DataFrame, dimension: DataFrame, fact_columns: Sequence[str], key: Sequence[str],
    attributes: Mapping[str, str],
) -> DataFrame:
    """Fact LEFT JOIN the current version of an SCD2 dimension."""
    current = dimension.filter("is_current")
    return star_join(fact, [DimensionLink(current, tuple(fact_columns), tuple(key), attributes)])


def scd2_asof_join(
    fact: DataFrame, dimension: DataFrame, fact_columns: Sequence[str], key: Sequence[str], at: str,
    attributes: Mapping[str, str], method: str = "auto", hot_key_rows: int | None = HOT_KEY_ROWS, disjoint: bool = False,
) -> DataFrame:
    """Fact LEFT JOIN the version of an SCD2 dimension valid at the fact's date ``at``; never more than one.

    A fact belongs to the version of its key that started last at or before ``at``, if that one is still valid then.
    Facts without a date or key and versions without a start or key match nothing; of versions that start together the
    one that lasts longest counts. Both methods give the same rows. ``disjoint`` promises that the versions of a key do
    not overlap, as those of our own snapshots and histories: they need not be put in order then.

    ``range`` joins on key and interval, as a broadcast or a skew-split merge join, and tries every version of
    a key on each of its facts. ``merge`` puts facts and versions in one time order per key and carries the
    last version forward: no pairs at all, and hot keys are cut into pieces of time (see ``hotkeys``). ``auto`` counts
    versions per key (one job over the dimension's key) and picks ``range`` up to ``MAX_RANGE_VERSIONS``.
    """
    require(fact, [*fact_columns, at], "scd2_asof_join, fact")
    require(dimension, [*key, "valid_from", "valid_to", *attributes.values()], "scd2_asof_join, dimension")
    if method == "auto":
        most = dimension.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
        method = "range" if most <= MAX_RANGE_VERSIONS else "merge"
    keys = [f"__k{i}" for i in range(len(key))]
    versions = _ordered_versions(dimension, key, keys, attributes, disjoint)
    if method == "range":
        return _asof_by_range(fact, versions, fact_columns, keys, at)
    if method == "merge":
        return _asof_by_merge(fact, versions, fact_columns, keys, at, attributes, hot_key_rows)
    raise ValueError(f"unknown method {method!r}")


def _ordered_versions(dimension, key, keys, attributes, disjoint: bool) -> DataFrame:
    """Versions as ``keys``, ``__from``, ``__to``, ``__version``, cut where the next version of the key starts."""
    versions = dimension.select(
        *(F.col(c).alias(k) for c, k in zip(key, keys)), F.col("valid_from").cast("timestamp_ntz").alias("__from"),
        F.col("valid_to").cast("timestamp_ntz").alias("__to"),
        F.struct(*(F.col(c).alias(n) for n, c in attributes.items())).alias("__version"),
    ).dropna(subset=[*keys, "__from"])
    if disjoint:
        return versions
    lasting = F.coalesce("__to", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    single = dedup_latest(versions.withColumn("__lasting", lasting), [*keys, "__from"], ["__lasting"]).drop("__lasting")
    following = F.lead("__from").over(Window.partitionBy(*keys).orderBy("__from"))
    return single.withColumn("__to", F.least("__to", following))


def _asof_by_range(fact, versions, fact_columns, keys, at) -> DataFrame:
    versions = versions.select(*keys, "__from", "__to", "__version.*")
    moment = F.col(at).cast("timestamp_ntz")
    valid = (moment >= F.col("__from")) & (F.col("__to").isNull() | (moment < F.col("__to")))
    on = reduce(Column.__and__, (F.col(c) == F.col(k) for c, k in zip(fact_columns, keys, strict=True)), valid)
    return fact.join(versions, on, "left").drop(*keys, "__from", "__to")


def _asof_by_merge(fact, versions, fact_columns, keys, at, attributes, hot_key_rows) -> DataFrame:
    facts = fact.select(*(F.col(c).alias(k) for c, k in zip(fact_columns, keys, strict=True)),
                        F.col(at).cast("timestamp_ntz").alias("__at"), F.struct(*fact.columns).alias("__fact"))
    versions = versions.select(*keys, F.col("__from").alias("__at"), F.struct("__to", "__version").alias("__version"))
    line = facts.unionByName(versions, allowMissingColumns=True)
    # At equal times the version comes before the fact.
    order = ["__at", F.col("__version").isNull(), F.xxhash64("__fact")]

    def so_far(window: WindowSpec) -> Column:
        return F.last("__version", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    if hot_key_rows is None:
        line = line.withColumn("__valid", so_far(Window.partitionBy(*keys).orderBy(*order[:2])))
    else:
        hot = hot_keys(line, keys, hot_key_rows)
        cold = without_hot(line, hot, keys).withColumn("__valid", so_far(Window.partitionBy(*keys).orderBy(*order[:2])))
        cut, inside, ends = with_ends(in_pieces(line, bounds_of(line, hot, keys, "__at"), keys, "__at"), keys, order)
        cut = cut.withColumn("__valid", so_far(inside))
        # The last row of a piece knows its last version; the first row of a piece gets that of the pieces before.
        known = F.when(F.col("__last"), F.col("__valid"))
        earlier = F.last(known, ignorenulls=True).over(ends.rowsBetween(Window.unboundedPreceding, -1))
        cut = cut.withColumn("__entering", F.when(F.col("__first"), earlier))
        entering = F.first("__entering").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        line = cold.unionByName(cut.withColumn("__valid", F.coalesce("__valid", entering)).select(*cold.columns))
    valid = F.col("__valid.__to").isNull() | (F.col("__at") < F.col("__valid.__to"))
    return (line.filter(F.col("__fact").isNotNull())
                .select("__fact.*", *(F.when(valid, F.col(f"__valid.__version.{n}")).alias(n) for n in attributes)))
