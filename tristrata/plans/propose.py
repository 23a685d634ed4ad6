"""Proposing a model: profiling finds keys and references, rules turn them into roles and specifications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tristrata.functions.columns import DATE_TYPES, FRACTION_TYPES, date_columns, is_date, is_measure
from tristrata.functions.names import AUDIT_DATES, PROVENANCE_KEYS, TRACKED_ENTITIES
from tristrata.operators.facts import effective_date
from tristrata.operators.profiling import discover_all_keys, discover_fks
from tristrata.plans.specs import (
    DimensionSpec, FactSpec, ForeignKey, GoldSpec, KeyPath, Metric, ModelSpec, TableSpec, unique_names,
)

_EDGE = "child_table string, fk int, child_column string, parent_table string, parent_column string"


@dataclass(frozen=True)
class Proposal:
    """``roles``: table_name, in_degree, out_degree, role, confidence; ``edges``: the references used."""

    model: ModelSpec
    roles: DataFrame
    edges: DataFrame
    keys: Mapping[str, list[tuple[str, ...]]]


def find_tables(
    sources: Mapping[str, DataFrame], declared: Mapping[str, TableSpec] | None = None, max_key_columns: int | None = None
) -> tuple[dict[str, TableSpec], dict[str, list[tuple[str, ...]]]]:
    """A ``TableSpec`` per table: the declared one, or keys and references found in the data.

    Keys of the least number of columns are searched, of any number unless ``max_key_columns`` ends the search; of
    several, integers are taken before dates before text, then in column order.
    A reference found is taken only when names agree; of two tables that contain each other's keys the
    earlier is the parent.
    """
    declared = declared or {}
    stated = {n: [declared[n].primary_key] for n in sources if n in declared and declared[n].primary_key}
    unknown = {n: df for n, df in sources.items() if n not in stated}
    keys = stated | discover_all_keys(unknown, max_key_columns, smallest_only=True)
    tables = {n: declared.get(n) or TableSpec(primary_key=_best_key(df, keys[n])) for n, df in sources.items()}
    if all(n in declared for n in sources):
        return tables, keys

    order = list(sources)
    links: dict[str, dict[str, ForeignKey]] = {n: {} for n in sources}
    fks = discover_fks(sources, keys).filter("evidence = 'name'").orderBy("child_table", "child_column", "rank")
    pairs = [(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]) for r in fks.collect()]
    for child, column, parent, parent_column in pairs:
        mutual = (parent, parent_column, child, column) in pairs
        if child not in declared and child != parent and not (mutual and order.index(child) < order.index(parent)):
            links[child].setdefault(column, ForeignKey((column,), parent, (parent_column,)))
    for name, found in links.items():
        if name not in declared:
            in_order = tuple(found[c] for c in sources[name].columns if c in found)
            tables[name] = replace(tables[name], foreign_keys=in_order)
    return tables, keys


def _best_key(df: DataFrame, keys: Sequence[tuple[str, ...]]) -> tuple[str, ...]:
    position = {c: i for i, c in enumerate(df.columns)}

    def cost(key):
        kinds = [df.schema[c].dataType for c in key]
        text = sum(isinstance(k, T.StringType) for k in kinds)
        dates = sum(isinstance(k, DATE_TYPES) for k in kinds)
        return len(key), text, dates, [position[c] for c in key]

    return min(keys, key=cost, default=())


def edge_frame(spark, tables: Mapping[str, TableSpec]) -> DataFrame:
    """References, one row per foreign key column; ``fk`` numbers a table's foreign keys."""
    rows = [(n, i, c, fk.parent, p) for n, t in tables.items() for i, fk in enumerate(t.foreign_keys)
            for c, p in zip(fk.columns, fk.parent_columns, strict=True)]
    return spark.createDataFrame(rows, _EDGE)


def column_frame(sources: Mapping[str, DataFrame], tables: Mapping[str, TableSpec]) -> DataFrame:
    """One row per table and column with the properties the role rules look at."""
    rows = []
    for name, df in sources.items():
        table = tables[name]
        for f in df.schema:
            lower = f.name.lower()
            dated = is_date(f) or lower.endswith("date") or lower.endswith("_at")
            rows.append((name, f.name, f.name in table.fk_columns, f.name in table.primary_key,
                         dated and lower not in AUDIT_DATES, isinstance(f.dataType, T.NumericType)))
    spark = next(iter(sources.values())).sparkSession
    return spark.createDataFrame(
        rows, "table_name string, column_name string, is_fk boolean, is_pk boolean, "
              "is_event_date boolean, is_numeric boolean")


def classify(
    columns: DataFrame, edges: DataFrame, overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Role of each table from its degree in the reference graph, its columns, and the user's overrides.

    Confidence runs from 1 (ambiguous) to 3.
    """
    own = ~F.col("is_fk") & ~F.col("is_pk")
    traits = columns.groupBy("table_name").agg(
        F.count_if(own).alias("own_columns"), F.bool_or("is_event_date").alias("dated"),
        F.bool_or(own & F.col("is_numeric")).alias("measured"))
    outgoing = edges.groupBy(F.col("child_table").alias("table_name")).agg(F.count_distinct("fk").alias("out_degree"))
    incoming = edges.groupBy(F.col("parent_table").alias("table_name")).agg(
        F.count_distinct("child_table", "fk").alias("in_degree"))
    graph = (traits.join(outgoing, "table_name", "left").join(incoming, "table_name", "left")
                   .na.fill(0, ["out_degree", "in_degree"]))

    leaf, linked = F.col("in_degree") == 0, F.col("out_degree")
    by_graph = (
        F.when(leaf & (linked >= 2), F.when(F.col("own_columns") <= 1, _role("bridge", 3)).otherwise(_role("fact", 3)))
         .when(leaf & (linked == 1), _role("dimension", 1))
         .when(leaf, _role("reference", 1))
         .when((linked >= 2) & F.col("dated"), _role("fact", 2))
         .when((linked == 0) & (F.col("in_degree") >= 2), _role("dimension", 3))
         .otherwise(_role("dimension", 2)))
    event = by_graph["role"].isin("bridge", "reference") & F.col("dated") & F.col("measured")
    settled = F.when(event, _role("fact", 3)).otherwise(by_graph)

    stated = columns.sparkSession.createDataFrame(
        list((overrides or {}).items()), "table_name string, stated string")
    return (graph.withColumn("found", settled).join(F.broadcast(stated), "table_name", "left")
                 .select("table_name", F.col("in_degree").cast("bigint"), F.col("out_degree").cast("bigint"),
                         F.coalesce("stated", "found.role").alias("role"),
                         F.when(F.col("stated").isNotNull(), 3).otherwise(F.col("found.confidence")).alias("confidence")))


def _role(role: str, confidence: int):
    return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))


def two_hop_frame(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Dimension keys each table reaches over two foreign keys; of several ways the first of its own keys wins.

    Columns the table has as keys itself, and columns recording who touched a row, are left out.
    """
    first = edges.select("child_table", "fk", F.col("parent_table").alias("via_table")).distinct()
    second = edges.select(F.col("child_table").alias("via_table"), F.col("fk").alias("second_fk"),
                          F.col("child_column").alias("carried_column"),
                          F.col("parent_table").alias("dimension_table"))
    own = edges.select("child_table", F.col("child_column").alias("carried_column"))
    dimensions = roles.filter("role = 'dimension'").select(F.col("table_name").alias("dimension_table"))
    paths = (first.join(second, "via_table").join(dimensions, "dimension_table", "left_semi")
                  .filter(~F.lower("carried_column").isin(*sorted(PROVENANCE_KEYS)))
                  .join(own, ["child_table", "carried_column"], "left_anti"))
    order = Window.partitionBy("child_table", "carried_column").orderBy("fk", "second_fk")
    return (paths.withColumn("n", F.row_number().over(order)).filter("n = 1")
                 .select("child_table", "fk", "via_table", "second_fk", "carried_column", "dimension_table"))


def scd_type(table: str) -> int:
    """2 for tables named after entities whose attributes change over time, else 1."""
    return 2 if any(word in table.lower() for word in TRACKED_ENTITIES) else 1


def propose_model(
    sources: Mapping[str, DataFrame], declared: Mapping[str, TableSpec] | None = None,
    overrides: Mapping[str, str] | None = None, partition_children: Mapping[str, str] | None = None,
    grain: str = "monthly",
) -> Proposal:
    """Profile the sources and derive a whole model.

    Dimensions and references become ``dim_<table>``; facts ``fct_<table>`` with all measures, references and
    two-hop keys; each fact gets one aggregate. ``partition_children`` maps child tables to the parent they
    are read through: they are not modelled themselves and show their parent's role.
    """
    children = {c: p for c, p in (partition_children or {}).items() if c in sources}
    modelled = {n: df for n, df in sources.items() if n not in children}
    tables, keys = find_tables(modelled, declared)
    spark = next(iter(sources.values())).sparkSession
    edges = edge_frame(spark, tables)
    roles = classify(column_frame(modelled, tables), edges, overrides)
    role = {r["table_name"]: r["role"] for r in roles.collect()}
    if children:
        inherited = [(c, 0, 0, role.get(p, "fact"), 3) for c, p in children.items()]
        roles = roles.unionByName(spark.createDataFrame(inherited, roles.schema))

    hops = two_hop_frame(edges, roles).orderBy("child_table", "fk", "second_fk", "carried_column").collect()
    paths = {n: tuple(KeyPath(tables[n].foreign_keys[h["fk"]], h["carried_column"], h["carried_column"])
                      for h in hops if h["child_table"] == n) for n in modelled}
    dimensions = tuple(DimensionSpec(f"dim_{n}", n, scd_type(n), tuple(modelled[n].columns), n)
                       for n in modelled if role[n] in ("dimension", "reference"))
    facts = tuple(_fact(n, modelled, tables, paths[n]) for n in modelled if role[n] == "fact")
    gold = unique_names(tuple(_gold(f, modelled, tables, role, grain) for f in facts))
    return Proposal(ModelSpec(tables, dimensions, facts, gold), roles, edges, keys)


def _fact(name: str, sources, tables, paths: tuple[KeyPath, ...]) -> FactSpec:
    df, table = sources[name], tables[name]
    links = table.fk_columns
    measures = [f.name for f in df.schema if is_measure(f) and f.name not in [*links, *table.primary_key]]
    identity = () if table.primary_key else tuple(
        f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, *FRACTION_TYPES)))
    return FactSpec(f"fct_{name}", name, tuple(links), tuple(measures), key_paths=paths,
                    natural_key=identity, factless=not measures, grain=", ".join(table.primary_key or identity),
                    length_prefixed=bool(identity))


def _gold(fact: FactSpec, sources, tables, role, grain: str) -> GoldSpec:
    """Sums of all measures and a row count by the fact's lookups; keys of its header count distinct."""
    headers = [fk for fk in tables[fact.source].foreign_keys
               if role.get(fk.parent) == "fact" or date_columns(sources[fk.parent], audit=False)]
    header_columns = [c for fk in headers for c in fk.columns]
    metrics = [Metric(f"total_{m}", "SUM", m) for m in fact.measures] + [Metric("row_count", "COUNT")]
    metrics += [Metric(f"{c}_count", "COUNT_DISTINCT", c) for c in header_columns]
    return GoldSpec(f"agg_{grain}_{fact.source}", fact.name, grain,
                    tuple(k for k in fact.dimension_keys if k not in header_columns), tuple(metrics),
                    effective_date(sources, fact, tables[fact.source]))
