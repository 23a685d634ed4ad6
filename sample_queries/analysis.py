"""Metrics, checks, profiling, proposed models and streams over the sample tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from sample_queries.model import ALL_TABLES, FCT_EVENTS, METRICS, MODEL, SALES, TABLES
from sample_queries.registry import load, query, snap
from sample_queries.star_schema import FACT_SQL, lineitem_fact, monthly_quantity
from tristrata.operators.metrics import query_metric
from tristrata.operators.facts import build_fact
from tristrata.operators.periods import cumulative
from tristrata.operators.profiling import discover_all_keys, discover_composite_fks, discover_fks, profile_tables
from tristrata.operators.quality import check_freshness, check_not_null, check_relationships, check_unique
from tristrata.plans.build import build_model
from tristrata.plans.propose import propose_model, two_hop_frame
from tristrata.plans.specs import GoldSpec, Metric
from tristrata.session import new_work_path
from tristrata.sources.incremental import read_fact
from tristrata.sources.tables import write_profile
from tristrata.streaming.streams import read_file_stream, stream_fact, stream_gold


def sales_models(spark, folder) -> dict[str, DataFrame]:
    t = load(spark, folder, "customer", "part")
    return {"fct_lineitem": lineitem_fact(spark, folder), "dim_customer": t["customer"], "dim_part": t["part"]}


def ask(spark, folder, names, grain=None, by=()) -> DataFrame:
    return query_metric(sales_models(spark, folder), SALES, METRICS, names, grain, by)


@query(FACT_SQL + """
select cast(date_trunc('month', l_shipdate) as date) as monthly_date, round(sum(net_revenue), 4) as total_revenue
from fct group by 1""")
def metric_simple(spark, folder):
    return snap(ask(spark, folder, ["total_revenue"], "monthly"), total_revenue=4)


@query(FACT_SQL + """
select cast(date_trunc('month', l_shipdate) as date) as month_date, l_returnflag as return_flag,
       sum(l_quantity) / nullif(count(*), 0) as quantity_per_line
from fct group by 1, 2""")
def metric_ratio(spark, folder):
    """Sums divided by counts at the time dimension's own grain, never an average of ratios."""
    return ask(spark, folder, ["quantity_per_line"], "default", ["return_flag"])


@query(FACT_SQL + """
select cast(date_trunc('year', l_shipdate) as date) as yearly_date, sum(l_quantity) as total_quantity,
       count(distinct l_orderkey) as orders, sum(l_quantity) / nullif(count(distinct l_orderkey), 0) as quantity_per_order
from fct group by 1""")
def metric_derived(spark, folder):
    return ask(spark, folder, ["total_quantity", "orders", "quantity_per_order"], "yearly")


@query(FACT_SQL + """, monthly as (
  select cast(date_trunc('month', l_shipdate) as date) as monthly_date, l_returnflag as return_flag,
         sum(l_quantity) as quantity
  from fct group by 1, 2)
select monthly_date, return_flag, sum(quantity) over (partition by return_flag order by monthly_date
                                                      rows unbounded preceding) as quantity_to_date
from monthly""")
def metric_cumulative(spark, folder):
    return ask(spark, folder, ["quantity_to_date"], "monthly", ["return_flag"])


@query(FACT_SQL + """
select cast(date_trunc('year', l_shipdate) as date) as yearly_date, c_mktsegment as customer__c_mktsegment,
       p_brand as part__p_brand, sum(l_quantity) as total_quantity, count(distinct l_orderkey) as orders,
       avg(l_quantity) as mean_quantity, max(l_extendedprice) as top_price,
       sum(l_quantity) / nullif(count(*), 0) as quantity_per_line
from fct left join customer on o_custkey = c_custkey left join part on l_partkey = p_partkey group by 1, 2, 3""")
def metric_by_dimension_attributes(spark, folder):
    """Metrics by attributes of two dimensions, joined after the fact is reduced to its keys."""
    return ask(spark, folder, ["total_quantity", "orders", "mean_quantity", "top_price", "quantity_per_line"],
               "yearly", ["customer__c_mktsegment", "part__p_brand"])


@query(FACT_SQL + """, monthly as (
  select cast(date_trunc('month', l_shipdate) as date) as monthly_date, sum(l_quantity) as quantity
  from fct group by 1)
select *, sum(quantity) over (order by monthly_date rows unbounded preceding) as cumulative from monthly""")
def cumulative_quantity(spark, folder):
    return cumulative(monthly_quantity(spark, folder), "quantity", "monthly_date")


@query("""
select 'lineitem' as model, 'unique' as "check", 'l_orderkey, l_linenumber' as columns, count(*) as failures,
       case when count(*) = 0 then 'pass' else 'fail' end as status
from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def check_unique_lines(spark, folder):
    return check_unique(load(spark, folder, "lineitem")["lineitem"], "lineitem", ["l_orderkey", "l_linenumber"])


@query("""
select 'lineitem' as model, 'not_null' as "check", columns, failures,
       case when failures = 0 then 'pass' else 'fail' end as status
from (select 'l_shipdate' as columns, count(*) - count(l_shipdate) as failures from lineitem union all
      select 'per_discount', count(*) - count(nullif(l_discount, 0)) from lineitem union all
      select 'per_tax', count(*) - count(nullif(l_tax, 0)) from lineitem)""")
def check_not_null_columns(spark, folder):
    lines = load(spark, folder, "lineitem")["lineitem"].withColumns(
        {"per_discount": F.nullif("l_discount", F.lit(0.0)), "per_tax": F.nullif("l_tax", F.lit(0.0))})
    return check_not_null(lines, "lineitem", ["l_shipdate", "per_discount", "per_tax"])


@query("""
select 'orders' as model, 'relationships' as "check", 'o_custkey' as columns, count(*) as failures,
       case when count(*) = 0 then 'pass' else 'fail' end as status
from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""")
def check_relationships_orders(spark, folder):
    """Orders whose customer is missing from a dimension without one segment."""
    t = load(spark, folder, "orders", "customer")
    kept = t["customer"].filter("c_mktsegment <> 'BUILDING'")
    return check_relationships(t["orders"], "orders", ["o_custkey"], kept, ["c_custkey"])


@query("""
select 'events' as model, 'freshness' as "check", 'ts' as columns, cast(late as bigint) as failures,
       case when late then 'warn' else 'pass' end as status
from (select timestamp '2024-02-01 06:00:00' - max(ts) > interval 24 hours as late from events)""")
def check_freshness_events(spark, folder):
    return check_freshness(load(spark, folder, "events")["events"], "events", "ts", "2024-02-01 06:00:00")


def _check_sql(model: str, check: str, columns: str, failures: str, status: str | None = None) -> str:
    status = status or "case when failures = 0 then 'pass' else 'fail' end"
    return (f"select '{model}' as model, '{check}' as \"check\", '{columns}' as columns, failures, {status} as status "
            f"from (select ({failures}) as failures)")


def _nulls(table: str, column: str) -> str:
    return f"select count(*) - count({column}) from {table}"


def _repeats(table: str, *columns: str) -> str:
    names = ", ".join(columns)
    return f"select count(*) from (select 1 from {table} group by {names} having count(*) > 1)"


def _orphans(table: str, column: str, parent: str, key: str) -> str:
    return f"select count(*) from {table} where {column} is not null and {column} not in (select {key} from {parent})"


_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
_CHECKS = [
    _check_sql("events", "freshness", "ts",
               "select cast(timestamp '2024-02-05 00:00:00' - max(ts) > interval 24 hours as bigint) from events",
               "(select case when timestamp '2024-02-05 00:00:00' - max(ts) > interval 48 hours then 'error' "
               "else 'warn' end from events)"),
    *(_check_sql(f"dim_{t}", check, f"dim_{t}_sk", sql(t, k))
      for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"),
                   ("nation", "n_nationkey"), ("region", "r_regionkey"))
      for check, sql in (("unique", _repeats), ("not_null", _nulls))),
    _check_sql("fct_lineitem", "unique", "fct_lineitem_sk", _repeats("lineitem", *_LINE_KEY)),
    _check_sql("fct_orders", "unique", "fct_orders_sk", _repeats("orders", "o_orderkey")),
    _check_sql("fct_events", "unique", "fct_events_sk", _repeats("events", "event_id")),
    *(_check_sql(m, "not_null", c, _nulls(t, source))
      for m, t, c, source in (
          ("fct_lineitem", "lineitem", "fct_lineitem_sk", "l_orderkey"),
          ("fct_lineitem", "lineitem", "l_orderkey", "l_orderkey"),
          ("fct_lineitem", "lineitem", "l_partkey", "l_partkey"),
          ("fct_lineitem", "lineitem", "l_suppkey", "l_suppkey"),
          ("fct_lineitem", "lineitem", "l_shipdate", "l_shipdate"),
          ("fct_orders", "orders", "fct_orders_sk", "o_orderkey"), ("fct_orders", "orders", "o_custkey", "o_custkey"),
          ("fct_orders", "orders", "o_orderdate", "o_orderdate"), ("fct_events", "events", "fct_events_sk", "event_id"),
          ("fct_events", "events", "user_id", "user_id"), ("fct_events", "events", "ts", "ts"),
          ("agg_monthly_revenue", "lineitem", "monthly_date", "l_shipdate"),
          ("agg_daily_orders", "orders", "daily_date", "o_orderdate"),
          ("agg_daily_events", "events", "daily_date", "ts"))),
    _check_sql("fct_lineitem", "relationships", "l_partkey", _orphans("lineitem", "l_partkey", "part", "p_partkey")),
    _check_sql("fct_lineitem", "relationships", "l_suppkey",
               _orphans("lineitem", "l_suppkey", "supplier", "s_suppkey")),
    _check_sql("fct_orders", "relationships", "o_custkey", _orphans("orders", "o_custkey", "customer", "c_custkey")),
    _check_sql("fct_events", "relationships", "user_id", _orphans("events", "user_id", "customer", "c_custkey")),
    _check_sql("agg_monthly_revenue", "unique", "monthly_date, o_custkey", "select 0"),
    _check_sql("agg_daily_orders", "unique", "daily_date", "select 0"),
    _check_sql("agg_daily_events", "unique", "daily_date, event_type", "select 0"),
]


@query(" union all ".join(_CHECKS))
def run_checks_of_model(spark, folder):
    """Every check the declared model implies."""
    sources = load(spark, folder, *TABLES)
    return build_model(sources, MODEL, "2024-02-05 00:00:00").checks("2024-02-05 00:00:00")


# Column names and kinds of the sample tables, for generating the profiling SQL.
_COLUMNS = {
    "region": "r_regionkey:int r_name:text",
    "nation": "n_nationkey:int n_name:text n_regionkey:int",
    "customer": "c_custkey:int c_name:text c_nationkey:int c_acctbal:num c_mktsegment:text",
    "supplier": "s_suppkey:int s_name:text s_nationkey:int s_acctbal:num",
    "part": "p_partkey:int p_name:text p_brand:text p_type:text p_size:int p_retailprice:num",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:text o_totalprice:num o_orderdate:date o_orderpriority:text",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:num l_extendedprice:num "
                "l_discount:num l_tax:num l_returnflag:text l_linestatus:text l_shipdate:date",
    "events": "event_id:int ts:date user_id:int event_type:text value:num props:text",
    "documents": "doc_id:int text:text lang:text source:text n_chars:int",
    "embeddings": "vec_id:int embedding:array label:int",
    "pages": "page_id:int url:text html:text",
    "benchmark": "item_id:int text:text",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:text text:text",
}
_KINDS = {t: [tuple(c.split(":")) for c in text.split()] for t, text in _COLUMNS.items()}


def _profile_sql() -> str:
    parts = []
    for table, columns in _KINDS.items():
        for i, (column, kind) in enumerate(columns, start=1):
            ends = ("null, null" if kind == "array"
                    else f"cast(min({column}) as varchar), cast(max({column}) as varchar)")
            parts.append(f"select '{table}', '{column}', {i}, count(*), count(*) - count({column}), "
                         f"count(distinct {column}), {ends} from {table}")
    names = "table_name, column_name, position, row_count, null_count, distinct_count, min_value, max_value"
    return f"with p({names}) as ({' union all '.join(parts)}) select * from p"


@query(_profile_sql())
def profile_columns_exact(spark, folder):
    """Statistics of every column of every table, distinct counts exact."""
    return profile_tables(load(spark, folder, *ALL_TABLES), exact=True).drop("data_type", "nullable")


def _keys_sql() -> str:
    """Try every combination of columns and keep the minimal ones without repeats and NULLs."""
    tried, smaller = [], []
    for table, columns in _KINDS.items():
        names = [c for c, kind in columns if kind in ("int", "text", "date")]
        for size in range(1, len(names) + 1):
            for combo in combinations(names, size):
                whole, some = ", ".join(combo), " or ".join(f"{c} is null" for c in combo)
                tried.append(f"select '{table}' as t, '{whole}' as k, {size} as n where not exists (select 1 from {table} where {some}) "
                             f"and not exists (select 1 from {table} group by {whole} having count(*) > 1)")
                smaller += [f"('{table}', '{whole}', '{', '.join(part)}')" for part in combinations(combo, size - 1) if part]
    # A unique combination is minimal unless it is unique without one of its columns.
    return f"""
with uniq as materialized ({' union all '.join(tried)}), parts(t, k, part) as (values {', '.join(smaller)})
select t as table_name, k as key_columns, cast(n as bigint) as n_columns from uniq u
where not exists (select 1 from parts p join uniq d on d.t = p.t and d.k = p.part where p.t = u.t and p.k = u.k)"""


@query(_keys_sql())
def discover_keys_of_tables(spark, folder):
    """Minimal keys of every table."""
    tables = load(spark, folder, *ALL_TABLES)
    rows = [(name, ", ".join(key), len(key)) for name, keys in discover_all_keys(tables).items() for key in keys]
    return spark.createDataFrame(rows, "table_name string, key_columns string, n_columns bigint")


def _inclusion_sql() -> str:
    """Distinct values of all integer and text columns, joined on the value to count what columns share."""
    cells, sizes = [], []
    for table, columns in _KINDS.items():
        for column, kind in columns:
            if kind in ("int", "text"):
                cells.append(f"select distinct '{table}' as t, '{column}' as c, '{kind}' as kind, "
                             f"cast({column} as varchar) as v from {table} where {column} is not null")
                sizes.append(f"select '{table}' as t, '{column}' as c, count(distinct {column}) as n, "
                             f"count(distinct {column}) = count(*) as is_key from {table}")
    return f"""
with cells as ({' union all '.join(cells)}), sizes as ({' union all '.join(sizes)}),
shared as (
  select a.t as ct, a.c as cc, b.t as pt, b.c as pc, count(*) as n
  from cells a join cells b on a.v = b.v and a.kind = b.kind and (a.t, a.c) <> (b.t, b.c) group by all
), found as (
  select ct as child_table, cc as child_column, pt as parent_table, pc as parent_column,
         s.n as child_distinct, p.n as parent_distinct, s.n / p.n as coverage,
         case when regexp_replace(cc, '^[a-z]{{1,2}}_', '') = regexp_replace(pc, '^[a-z]{{1,2}}_', '')
              then 'name' else 'containment only' end as evidence
  from shared join sizes s on s.t = ct and s.c = cc and s.n = shared.n
  join sizes p on p.t = pt and p.c = pc and p.is_key
), dependencies as (
  select *, cast(row_number() over (partition by child_table, child_column
                 order by evidence <> 'name', coverage desc, parent_table, parent_column) as integer) as rank
  from found
)"""


@query(_inclusion_sql() + " select * from dependencies")
def discover_fks_of_tables(spark, folder):
    """Every inclusion of an integer or text column in a single-column key, ranked per column."""
    tables = load(spark, folder, *ALL_TABLES)
    return discover_fks(tables, discover_all_keys(tables, 1))


@query("""
with returned as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_orderkey is not null and l_linenumber is not null),
lines as (select distinct l_orderkey, l_linenumber from lineitem where l_orderkey is not null and l_linenumber is not null)
select 'returned' as child_table, 'back_order,back_line' as child_columns, 'lineitem' as parent_table, 'l_orderkey,l_linenumber' as parent_columns,
  a.n as child_distinct, b.n as parent_distinct, a.n / b.n as coverage, 'containment only' as evidence, 1::integer as rank
from (select count(*) as n from returned) a, (select count(*) as n from lines) b
""")
def discover_composite_fks_of_lines(spark, folder):
    """Returned lines, without names that tell, find the key of two columns that they refer to."""
    lines = load(spark, folder, "lineitem")["lineitem"]
    returned = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("back_order"), F.col("l_linenumber").alias("back_line"))
    found = discover_composite_fks({"lineitem": lines, "returned": returned}, {"lineitem": [("l_orderkey", "l_linenumber")]})
    return found.withColumns({c: F.array_join(c, ",") for c in ("child_columns", "parent_columns")})


_EDGES_SQL = _inclusion_sql() + """, edges as (
  select child_table, child_column, parent_table, parent_column from dependencies d
  where evidence = 'name' and child_table <> parent_table and rank = (
    select min(rank) from dependencies e where evidence = 'name' and e.child_table <> e.parent_table
    and e.child_table = d.child_table and e.child_column = d.child_column)
)"""

_TABLE_TRAITS = ", ".join(
    f"('{t}', {str(any(kind == 'date' for _, kind in columns)).lower()})" for t, columns in _KINDS.items())


@query(_EDGES_SQL + f""", traits(table_name, dated) as (values {_TABLE_TRAITS}), graph as (
  select table_name, dated, (select count(*) from edges where parent_table = table_name) as in_degree,
         (select count(*) from edges where child_table = table_name) as out_degree
  from traits
)
select table_name, in_degree, out_degree,
       case when table_name in ('orders', 'events') then 'fact' when out_degree >= 2 and in_degree = 0 then 'fact'
            when in_degree >= 1 and out_degree >= 2 and dated then 'fact'
            when in_degree = 0 and out_degree = 0 then 'reference' else 'dimension' end as role,
       cast(case when table_name in ('orders', 'events') then 3 when out_degree >= 2 and in_degree = 0 then 3
                 when in_degree >= 2 and out_degree = 0 then 3 when in_degree >= 1 then 2 else 1 end as integer)
         as confidence
from graph""")
def propose_model_roles(spark, folder):
    """Roles of all tables from keys and references found in the data, two of them stated by the user."""
    sources = load(spark, folder, *ALL_TABLES)
    return propose_model(sources, overrides={"orders": "fact", "events": "fact"}).roles


@query(_EDGES_SQL + """
select a.child_table, a.parent_table as via_table, b.child_column as carried_column, b.parent_table as dimension_table
from edges a join edges b on b.child_table = a.parent_table
where b.parent_table not in ('orders', 'events', 'lineitem')
and not exists (select 1 from edges o where o.child_table = a.child_table and o.child_column = b.child_column)""")
def propose_model_paths(spark, folder):
    """Dimension keys two references away from each table."""
    proposal = propose_model(load(spark, folder, *ALL_TABLES), overrides={"orders": "fact", "events": "fact"})
    return two_hop_frame(proposal.edges, proposal.roles).drop("fk", "second_fk")


@query("""
select cast(date_trunc('month', l_shipdate) as date) as monthly_date, l_partkey, l_suppkey,
       sum(l_quantity) as total_l_quantity, round(sum(l_extendedprice), 2) as total_l_extendedprice,
       round(sum(l_discount), 2) as total_l_discount, round(sum(l_tax), 2) as total_l_tax, count(*) as row_count,
       count(distinct l_orderkey) as l_orderkey_count
from lineitem group by 1, 2, 3""")
def auto_model(spark, folder):
    """Found keys, proposed model, built tables: the default aggregate of the order lines."""
    sources = load(spark, folder, "region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    proposal = propose_model(sources, overrides={"orders": "fact"})
    gold = build_model(sources, proposal.model, "2024-01-01 00:00:00").tables["agg_monthly_lineitem"]
    return snap(gold, total_l_extendedprice=2, total_l_discount=2, total_l_tax=2)


@query("""select md5(cast(event_id as varchar)) as fct_events_sk, user_id, event_type, event_id, ts from events""")
def stream_fact_events(spark, folder):
    """The events as a stream of files, upserted into a fact."""
    schema = load(spark, folder, "events")["events"].schema
    path, checkpoint = new_work_path(spark, "fct_events"), new_work_path(spark, "stream")
    stream = read_file_stream(spark, folder, schema, "events.parquet")
    stream_fact(stream, lambda batch: build_fact({"events": batch}, FCT_EVENTS, TABLES), path, "fct_events_sk", "ts",
                checkpoint).awaitTermination()
    return read_fact(spark, path)


@query("""
select md5(concat_ws('-', coalesce(cast(monthly_date as varchar), '_dbt_utils_surrogate_key_null_'), event_type)) as agg_monthly_events_sk, *
from (select cast(date_trunc('month', case when event_id % 10 <> 0 then ts end) as date) as monthly_date, event_type,
             count(*) as events, min(value) as least from events group by 1, 2)""")
def stream_gold_undated(spark, folder):
    """A monthly aggregate kept up to date by a stream in which every tenth event has no date."""
    schema = load(spark, folder, "events")["events"].schema
    spec = GoldSpec("agg_monthly_events", "events", "monthly", ("event_type",),
                    (Metric("events", "COUNT"), Metric("least", "MIN", "value")), "ts")
    path, checkpoint = new_work_path(spark, "agg_monthly_events"), new_work_path(spark, "stream")
    stream = read_file_stream(spark, folder, schema, "events.parquet")
    stream = stream.withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    stream_gold(stream, spec, path, checkpoint).awaitTermination()
    return read_fact(spark, path)


@query("""
select md5(concat_ws('-', cast(weekly_date as varchar), event_type)) as agg_weekly_events_sk, *
from (select cast(date_trunc('week', ts) as date) as weekly_date, event_type, count(*) as events,
             max(value) as greatest from events group by 1, 2)""")
def stream_gold_events(spark, folder):
    """A weekly aggregate kept up to date by a stream."""
    schema = load(spark, folder, "events")["events"].schema
    spec = GoldSpec("agg_weekly_events", "events", "weekly", ("event_type",),
                    (Metric("events", "COUNT"), Metric("greatest", "MAX", "value")), "ts")
    path, checkpoint = new_work_path(spark, "agg_weekly_events"), new_work_path(spark, "stream")
    stream = read_file_stream(spark, folder, schema, "events.parquet")
    stream_gold(stream, spec, path, checkpoint).awaitTermination()
    return read_fact(spark, path)


@query("""
select md5(concat_ws('-', cast(monthly_date as varchar), event_type)) as agg_monthly_users_sk, *
from (select cast(date_trunc('month', ts) as date) as monthly_date, event_type, count(*) as events, count(distinct user_id) as users,
             count(distinct cast(trunc(value) as int)) as amounts, count(value) as priced, max(event_type) as kind from events group by 1, 2)""")
def stream_gold_distinct(spark, folder):
    """A monthly aggregate with exact distinct counts, kept up to date by a stream over two runs."""
    events = load(spark, folder, "events")["events"].withColumn("amount", F.col("value").cast("int"))
    arriving, path, checkpoint = (new_work_path(spark, n) for n in ("arriving", "agg_monthly_users", "stream"))
    spec = GoldSpec("agg_monthly_users", "events", "monthly", ("event_type",), (
        Metric("events", "COUNT"), Metric("users", "COUNT_DISTINCT", "user_id"), Metric("amounts", "COUNT_DISTINCT", "amount"),
        Metric("priced", "COUNT", "value"), Metric("kind", "MAX", "event_type")), "ts")
    for half in (0, 1):
        events.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(arriving)
        stream_gold(read_file_stream(spark, arriving, events.schema), spec, path, checkpoint).awaitTermination()
    return read_fact(spark, path)


@query(_profile_sql().replace("select * from p", "select table_name, column_name, position, row_count, null_count, distinct_count > 0 as has_values, min_value, max_value from p"))
def profile_exported(spark, folder):
    """The sketched profile of every table, exported as JSON and read again."""
    path = new_work_path(spark, "profile")
    write_profile(profile_tables(load(spark, folder, *ALL_TABLES)), path)
    kinds = "table_name string, column_name string, position int, row_count long, null_count long, distinct_count long, min_value string, max_value string"
    read = spark.read.schema(kinds).json(path)
    return read.withColumn("has_values", F.col("distinct_count") > 0).drop("distinct_count")
