"""Slowly changing dimensions, comparisons of versions and incremental loads over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sample_queries.model import FCT_LINEITEM, FCT_ORDERS, TABLES
from sample_queries.registry import load, query, snap
from tristrata.operators.dedup import dedup_latest
from tristrata.operators.diff import change_rate, table_diff
from tristrata.operators.dimensions import build_dimension_scd2
from tristrata.operators.facts import build_fact
from tristrata.operators.scd import scd2_from_history, snapshot_check, snapshot_timestamp
from tristrata.operators.star import scd2_asof_join, scd2_current_join
from tristrata.plans.build import read_dimension, run_model
from tristrata.plans.specs import DimensionSpec, GoldSpec, Metric, ModelSpec
from tristrata.session import new_work_path
from tristrata.sources.incremental import (
    incremental_filter, merge_months, newest_date, read_fact, refresh_gold, upsert_incremental,
)
from tristrata.sources.tables import advance_snapshot, read_open_versions, read_snapshot, write_snapshot

PRIORITY_SQL = """
with log as (
  select o_custkey, o_orderdate, o_orderpriority from orders
  qualify row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) = 1
), runs as (
  select *, row_number() over w as n, lag(o_orderpriority) over w as before
  from log window w as (partition by o_custkey order by o_orderdate)
), versions as (
  select o_custkey, o_orderpriority, o_orderdate as valid_from,
         lead(o_orderdate) over (partition by o_custkey order by o_orderdate) as valid_to
  from runs where n = 1 or o_orderpriority is distinct from before
)"""

TYPE_SQL = """
with log as (
  select event_type, ts, user_id from events
  qualify row_number() over (partition by event_type, ts order by event_id desc) = 1
), runs as (
  select *, row_number() over w as n, lag(user_id) over w as before
  from log window w as (partition by event_type order by ts)
), versions as (
  select event_type, user_id, ts as valid_from, lead(ts) over (partition by event_type order by ts) as valid_to
  from runs where n = 1 or user_id is distinct from before
)"""


def priority_history(spark, folder, **options) -> DataFrame:
    """Priority of each customer over time, from their orders."""
    return scd2_from_history(load(spark, folder, "orders")["orders"], ["o_custkey"], "o_orderdate",
                             ["o_orderpriority"], ["o_orderkey"], **options)


@query(PRIORITY_SQL + "select *, valid_to is null as is_current from versions")
def scd2_history(spark, folder):
    return priority_history(spark, folder)


@query(TYPE_SQL + "select *, valid_to is null as is_current from versions")
def scd2_history_hot_keys(spark, folder):
    """Few keys with very many changes each: every key is hot and handled in pieces of time."""
    return scd2_from_history(load(spark, folder, "events")["events"], ["event_type"], "ts", ["user_id"],
                             ["event_id"], hot_key_rows=100)


@query(PRIORITY_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_shipdate, o.o_custkey, v.o_orderpriority as priority
from lineitem join orders o on l_orderkey = o_orderkey
left join versions v on v.o_custkey = o.o_custkey and l_shipdate >= valid_from
                    and (valid_to is null or l_shipdate < valid_to)""")
def scd2_asof(spark, folder):
    """Order lines with the customer's priority valid on the ship date."""
    return scd2_asof_join(_lines(spark, folder), priority_history(spark, folder), ["o_custkey"], ["o_custkey"],
                          "l_shipdate", {"priority": "o_orderpriority"}, disjoint=True)


@query(TYPE_SQL + """
select e.event_id, e.event_type, e.ts, v.user_id as previous_user
from events e left join versions v on v.event_type = e.event_type and e.ts - interval 1 minute >= valid_from
                                  and (valid_to is null or e.ts - interval 1 minute < valid_to)""")
def scd2_asof_hot_keys(spark, folder):
    """Hot keys on both sides: facts and versions are merged in time order, in pieces."""
    events = load(spark, folder, "events")["events"]
    versions = scd2_from_history(events, ["event_type"], "ts", ["user_id"], ["event_id"])
    facts = events.select("event_id", "event_type", "ts", F.expr("ts - INTERVAL 1 MINUTE").alias("seen_at"))
    joined = scd2_asof_join(facts, versions, ["event_type"], ["event_type"], "seen_at",
                            {"previous_user": "user_id"}, method="merge", hot_key_rows=100, disjoint=True)
    return joined.drop("seen_at")


@query(PRIORITY_SQL + """
select l_orderkey, l_linenumber, l_partkey, l_shipdate, o.o_custkey, v.o_orderpriority as priority
from lineitem join orders o on l_orderkey = o_orderkey
left join versions v on v.o_custkey = o.o_custkey and valid_to is null""")
def scd2_current(spark, folder):
    return scd2_current_join(_lines(spark, folder), priority_history(spark, folder), ["o_custkey"], ["o_custkey"],
                             {"priority": "o_orderpriority"})


def _lines(spark, folder) -> DataFrame:
    fact = build_fact(load(spark, folder, "lineitem", "orders"), FCT_LINEITEM, TABLES)
    return fact.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "o_custkey")


def customer_versions(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The customer table as it is, and a later state: one nation's customers gone, balances of one segment
    raised and negative ones cleared, the suppliers added as customers."""
    t = load(spark, folder, "customer", "supplier")
    balance = (F.when(F.col("c_acctbal") < 0, F.lit(None))
                .when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")))
    later = t["customer"].filter("c_nationkey <> 7").withColumn("c_acctbal", balance)
    added = t["supplier"].select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"),
                                 F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
                                 F.lit("SUPPLIER").alias("c_mktsegment"))
    return t["customer"], later.unionByName(added)


LATER_SQL = """
with later as (
  select c_custkey, c_name, c_nationkey,
         case when c_acctbal < 0 then null when c_mktsegment = 'BUILDING' then c_acctbal + 100
              else c_acctbal end as c_acctbal, c_mktsegment
  from customer where c_nationkey <> 7
  union all
  select -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' from supplier
), pairs as (
  select o.c_custkey as old_key, n.c_custkey as new_key,
         (o.c_name, o.c_nationkey, o.c_acctbal, o.c_mktsegment)
           is distinct from (n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment) as differs,
         o.c_name as o_name, o.c_nationkey as o_nation, o.c_acctbal as o_balance, o.c_mktsegment as o_segment,
         n.c_name as n_name, n.c_nationkey as n_nation, n.c_acctbal as n_balance, n.c_mktsegment as n_segment
  from customer o full join later n on o.c_custkey = n.c_custkey
)"""


def _snapshot_sql(missing_closed: bool) -> str:
    closed = "new_key is null" if missing_closed else "false"
    return LATER_SQL + f"""
select old_key as c_custkey, o_name as c_name, o_nation as c_nationkey, o_balance as c_acctbal,
       o_segment as c_mktsegment, timestamp '2024-01-01' as valid_from,
       case when (new_key is not null and differs) or {closed} then timestamp '2024-02-01' end as valid_to
from pairs where old_key is not null
union all
select new_key, n_name, n_nation, n_balance, n_segment, timestamp '2024-02-01', null
from pairs where new_key is not null and (old_key is null or differs)"""


@query(_snapshot_sql(missing_closed=False))
def snapshot_check_second_run(spark, folder):
    first, later = customer_versions(spark, folder)
    snapshot = snapshot_check(None, first, ["c_custkey"], "2024-01-01 00:00:00")
    return snapshot_check(snapshot, later, ["c_custkey"], "2024-02-01 00:00:00")


@query(_snapshot_sql(missing_closed=True))
def snapshot_check_close_missing(spark, folder):
    first, later = customer_versions(spark, folder)
    snapshot = snapshot_check(None, first, ["c_custkey"], "2024-01-01 00:00:00")
    return snapshot_check(snapshot, later, ["c_custkey"], "2024-02-01 00:00:00", close_missing=True)


@query("""
select c_custkey, c_mktsegment, timestamp '2024-01-01' as updated_at, timestamp '2024-01-01' as valid_from,
       case when c_mktsegment = 'BUILDING' then timestamp '2024-02-01' end as valid_to from customer
union all
select c_custkey, c_mktsegment, timestamp '2024-02-01', timestamp '2024-02-01', null
from customer where c_mktsegment = 'BUILDING'""")
def snapshot_timestamp_second_run(spark, folder):
    customer = load(spark, folder, "customer")["customer"].select("c_custkey", "c_mktsegment")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    first = customer.withColumn("updated_at", start)
    touched = F.col("c_mktsegment") == "BUILDING"
    later = customer.withColumn("updated_at", F.when(touched, F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
                                .otherwise(start))
    snapshot = snapshot_timestamp(None, first, ["c_custkey"], "updated_at")
    return snapshot_timestamp(snapshot, later, ["c_custkey"], "updated_at")


@query("""
with first as (
  select c_custkey, c_mktsegment, case when c_custkey % 3 <> 0 then timestamp '2024-01-01' end as updated_at,
         case when c_custkey % 3 <> 0 then timestamp '2024-01-01' end as valid_from from customer
), later as (
  select c_custkey, case when c_custkey % 2 = 0 then 'CHANGED' else c_mktsegment end as c_mktsegment,
         case when c_custkey % 2 = 0 then timestamp '2024-02-01' end as updated_at from customer
)
select f.*, l.updated_at as valid_to from first f join later l using (c_custkey)
union all
select c_custkey, c_mktsegment, updated_at, updated_at, null from later where updated_at is not null""")
def snapshot_timestamp_null_stamp(spark, folder):
    """Keys first seen without an update stamp change with their first stamp; rows without one change nothing."""
    customer = load(spark, folder, "customer")["customer"].select("c_custkey", "c_mktsegment")
    at = lambda day: F.lit(f"2024-{day} 00:00:00").cast("timestamp_ntz")
    even = F.col("c_custkey") % 2 == 0
    first = customer.withColumn("updated_at", F.when(F.col("c_custkey") % 3 != 0, at("01-01")))
    later = customer.withColumns({
        "c_mktsegment": F.when(even, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")), "updated_at": F.when(even, at("02-01"))})
    return snapshot_timestamp(snapshot_timestamp(None, first, ["c_custkey"], "updated_at"), later, ["c_custkey"], "updated_at")


@query("""
with versions as (
  select o_custkey, o_orderdate as valid_from, max(o_orderdate + interval 400 days) as valid_to, max(o_orderpriority) as priority
  from orders where o_orderkey % 7 <> 0 group by 1, 2
), cut as (
  select *, least(valid_to, lead(valid_from) over (partition by o_custkey order by valid_from)) as until from versions
), facts as (select o_orderkey, o_custkey, case when o_orderkey % 5 <> 0 then o_orderdate end as moment from orders)
select o_orderkey, priority from facts f
left join cut c on c.o_custkey = f.o_custkey and moment >= valid_from and moment < until""")
def scd2_asof_null_starts(spark, folder):
    """Overlapping versions, versions without a start and facts without a date; half of the keys by each method."""
    orders = load(spark, folder, "orders")["orders"]
    facts = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("at"))
    starts = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("valid_from")
    versions = orders.groupBy("o_custkey", starts).agg(F.max("o_orderpriority").alias("priority"))
    versions = versions.withColumn("valid_to", F.col("valid_from") + F.expr("interval 400 days"))
    even = F.col("o_custkey") % 2 == 0
    return scd2_asof_join(facts.filter(even), versions, ["o_custkey"], ["o_custkey"], "at", {"priority": "priority"}, method="range").unionByName(
        scd2_asof_join(facts.filter(~even), versions, ["o_custkey"], ["o_custkey"], "at", {"priority": "priority"}, method="merge")
    ).select("o_orderkey", "priority")


@query("""
select md5(concat_ws('-', cast(c_custkey as varchar), '2024-01-01 00:00:00')) as dim_customer_sk,
       c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, timestamp '2024-01-01' as valid_from,
       cast(null as timestamp) as valid_to, true as is_current
from customer""")
def dim_customer_scd2(spark, folder):
    first, _ = customer_versions(spark, folder)
    snapshot = snapshot_check(None, first, ["c_custkey"], "2024-01-01 00:00:00")
    return build_dimension_scd2(snapshot, DimensionSpec("dim_customer", "customer", 2), TABLES["customer"])


@query(LATER_SQL + """
select coalesce(old_key, new_key) as c_custkey,
       case when old_key is null then 'added' when new_key is null then 'removed' else 'changed' end as change_type,
       o_balance as old_balance, n_balance as new_balance
from pairs where old_key is null or new_key is null or differs""")
def table_diff_customer(spark, folder):
    diff = table_diff(*customer_versions(spark, folder), ["c_custkey"])
    return diff.select("c_custkey", "change_type", F.col("old.c_acctbal").alias("old_balance"),
                       F.col("new.c_acctbal").alias("new_balance"))


@query(LATER_SQL + """
select count(old_key + new_key) as shared_keys, count(*) filter (old_key + new_key is not null and differs) as changed_keys,
       count(*) filter (old_key is null) as added_keys, count(*) filter (new_key is null) as removed_keys,
       count(*) filter (old_key + new_key is not null and differs) / count(old_key + new_key) as change_rate
from pairs""")
def change_rate_customer(spark, folder):
    return change_rate(*customer_versions(spark, folder), ["c_custkey"])


@query("""select * from orders
          qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def dedup_latest_order(spark, folder):
    return dedup_latest(load(spark, folder, "orders")["orders"], ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""
with first_load as (
  select * from lineitem where l_shipdate <= timestamp '2001-06-30' and l_returnflag <> 'R'
), recent as (
  select * from lineitem where l_shipdate > (select max(l_shipdate) - interval 7 days from first_load)
), stored as (
  select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity from first_load
  union
  select l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity from recent
)
select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
                     cast(l_shipdate as varchar))) as fct_lineitem_sk, l_shipdate, l_quantity from stored""")
def incremental_lookback(spark, folder):
    """A first load, then a run over everything: rows that arrive later than the lookback stay lost."""
    sources = load(spark, folder, "lineitem", "orders")
    everything = build_fact(sources, FCT_LINEITEM, TABLES).select("fct_lineitem_sk", "l_shipdate", "l_quantity")
    early = sources["lineitem"].filter("l_shipdate <= timestamp_ntz'2001-06-30 00:00:00' and l_returnflag <> 'R'")
    first = build_fact(sources | {"lineitem": early}, FCT_LINEITEM, TABLES).select(*everything.columns)
    path = new_work_path(spark, "fct_lineitem")
    merge_months(first, path, "fct_lineitem_sk", "l_shipdate", key_has_date=True)
    recent = incremental_filter(everything, "l_shipdate", newest_date(spark, path, "l_shipdate"))
    merge_months(recent, path, "fct_lineitem_sk", "l_shipdate", key_has_date=True)
    return read_fact(spark, path, otherwise=everything)


@query("""
select o_orderkey, case when o_orderstatus = 'O' then o_orderdate + interval 40 days else o_orderdate end as o_orderdate,
       case when o_orderstatus = 'O' then 'moved' else o_orderstatus end as state from orders""")
def upsert_moves_months(spark, folder):
    """Rows whose date moves to another month leave their old month's folder."""
    orders = load(spark, folder, "orders")["orders"].select(
        "o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("state"))
    path = new_work_path(spark, "orders")
    upsert_incremental(orders, path, "o_orderkey", "o_orderdate")
    moved = orders.filter("state = 'O'").withColumns(
        {"o_orderdate": F.expr("o_orderdate + INTERVAL 40 DAYS"), "state": F.lit("moved")})
    return upsert_incremental(moved, path, "o_orderkey", "o_orderdate")


@query("""select l_partkey, l_suppkey, sum(l_quantity) as quantity from lineitem group by 1, 2
          union all select p_partkey, -1, 0 from part""")
def upsert_undated(spark, folder):
    """An undated table is rewritten as a new version read from the previous one."""
    t = load(spark, folder, "lineitem", "part")
    key = F.concat_ws("-", "l_partkey", "l_suppkey").alias("pair")
    pairs = t["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    path = new_work_path(spark, "pairs")
    upsert_incremental(pairs.select(key, "*").withColumn("quantity", F.lit(-1.0)), path, "pair")
    upsert_incremental(pairs.select(key, "*"), path, "pair")
    parts = t["part"].select(F.col("p_partkey").alias("l_partkey"), F.lit(-1).cast("bigint").alias("l_suppkey"),
                             F.lit(0.0).alias("quantity"))
    return upsert_incremental(parts.select(key, "*"), path, "pair").drop("pair")


@query(_snapshot_sql(missing_closed=False))
def stored_snapshot_history(spark, folder):
    """A stored snapshot after two runs: the second starts from the open versions that the first stored."""
    first, later = customer_versions(spark, folder)
    path = new_work_path(spark, "snap_customer")
    write_snapshot(snapshot_check(None, first, ["c_custkey"], "2024-01-01 00:00:00"), path)
    write_snapshot(snapshot_check(read_open_versions(spark, path), later, ["c_custkey"], "2024-02-01 00:00:00"), path)
    return read_snapshot(spark, path)


STORED_SQL = """
with first_load as (
  select * from orders where o_orderdate <= timestamp '2001-06-30' and o_orderstatus <> 'P'
), recent as (
  select * from orders where o_orderdate > (select max(o_orderdate) - interval 7 days from first_load)
), stored as (select * from first_load union select * from recent)"""


def _first_orders(orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderdate <= timestamp_ntz'2001-06-30 00:00:00' and o_orderstatus <> 'P'")


@query(STORED_SQL + """
select cast(date_trunc('week', o_orderdate) as date) as weekly_date, o_orderstatus, count(*) as orders, min(o_totalprice) as least
from stored group by 1, 2""")
def refresh_gold_months(spark, folder):
    """An aggregate by week, first built and then refreshed for the months that an upsert has changed."""
    orders = load(spark, folder, "orders")["orders"]
    fact, gold = new_work_path(spark, "fct_orders"), new_work_path(spark, "agg_weekly")
    spec = GoldSpec("agg_weekly", "fct_orders", "weekly", ("o_orderstatus",), (Metric("orders", "COUNT"), Metric("least", "MIN", "o_totalprice")))
    merge_months(_first_orders(orders), fact, "o_orderkey", "o_orderdate")
    refresh_gold(spark, fact, gold, spec, "o_orderdate")
    recent = incremental_filter(orders, "o_orderdate", newest_date(spark, fact, "o_orderdate"))
    months = merge_months(recent, fact, "o_orderkey", "o_orderdate")
    return refresh_gold(spark, fact, gold, spec, "o_orderdate", months=months)


@query(STORED_SQL + """
select cast(o_orderdate as date) as daily_date, round(sum(o_totalprice), 2) as order_value from stored group by 1""")
def stored_model_two_runs(spark, folder):
    """The daily aggregate of a stored model after two runs, the second over everything and with late orders."""
    sources = load(spark, folder, "customer", "orders")
    model = ModelSpec({n: TABLES[n] for n in sources}, (DimensionSpec("dim_customer", "customer", 2),), (FCT_ORDERS,), (
        GoldSpec("agg_daily_orders", "fct_orders", "daily", (), (Metric("order_value", "SUM", "o_totalprice"),)),))
    root = new_work_path(spark, "model")
    run_model(spark, sources | {"orders": _first_orders(sources["orders"])}, model, root, "2024-01-01 00:00:00")
    return snap(run_model(spark, sources, model, root, "2024-02-01 00:00:00").tables["agg_daily_orders"], order_value=2)


_DIMENSION_MODEL = ModelSpec({n: TABLES[n] for n in ("customer", "orders")}, (DimensionSpec("dim_customer", "customer", 2),), (FCT_ORDERS,), ())


def _two_runs(spark, folder, root: str):
    """A stored model after two runs: the later one with changed customers and all orders."""
    sources = load(spark, folder, "orders")
    first, later = customer_versions(spark, folder)
    run_model(spark, {"customer": first, "orders": _first_orders(sources["orders"])}, _DIMENSION_MODEL, root, "2024-01-01 00:00:00")
    return run_model(spark, {"customer": later, "orders": sources["orders"]}, _DIMENSION_MODEL, root, "2024-02-01 00:00:00")


@query(_snapshot_sql(missing_closed=False).replace(LATER_SQL, LATER_SQL + ", versions as (") + """)
select md5(concat_ws('-', cast(c_custkey as varchar), strftime(valid_from, '%Y-%m-%d %H:%M:%S'))) as dim_customer_sk, versions.*,
       valid_to is null as is_current from versions""")
def stored_dimension_two_runs(spark, folder):
    """The SCD2 dimension of a stored model after two runs, read as another session would."""
    root = new_work_path(spark, "model")
    _two_runs(spark, folder, root)
    return read_dimension(spark, root, _DIMENSION_MODEL.dimensions[0], TABLES["customer"])


@query(STORED_SQL + """
select md5(cast(s.o_orderkey as varchar)) as fct_orders_sk, s.o_custkey, s.o_orderkey, s.o_orderdate, s.o_totalprice,
       case when r.o_orderkey is null or c.c_nationkey <> 7 then c.c_nationkey end as c_nationkey
from stored s left join recent r using (o_orderkey) left join customer c on c.c_custkey = s.o_custkey""")
def stored_fact_two_runs(spark, folder):
    """The fact of the same model: late orders are lost, those of the last days carry the nation their customer has now."""
    return _two_runs(spark, folder, new_work_path(spark, "model")).tables["fct_orders"]


@query(LATER_SQL + """
select count(*) as customers, count(c_acctbal) as balances, cast(sum(c_nationkey) as bigint) as nations from later""")
def published_view_of_a_run(spark, folder):
    """The view of the staged customers that the last run of a stored model has published."""
    _two_runs(spark, folder, new_work_path(spark, "model"))
    return spark.table("stg_public_customer").agg(
        F.count("*").alias("customers"), F.count("c_acctbal").alias("balances"), F.sum("c_nationkey").alias("nations"))


@query("""
with joined as (select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, n_name from customer left join nation on n_nationkey = c_nationkey and n_regionkey <> 2)
select c_custkey, c_name, c_nationkey, cast(null as varchar) as n_name, timestamp '2024-01-01' as valid_from,
       case when n_name is not null then timestamp '2024-02-01' end as valid_to from joined
union all select c_custkey, c_name, c_nationkey, n_name, timestamp '2024-02-01', null from joined where n_name is not null""")
def stored_snapshot_new_column(spark, folder):
    """A stored snapshot whose source gains a column and widens a type between two runs."""
    t = load(spark, folder, "customer", "nation")
    first = t["customer"].select("c_custkey", "c_name", "c_nationkey")
    named = t["nation"].filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    later = first.join(named, "c_nationkey", "left").withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))
    path = new_work_path(spark, "snap_customer")
    for run_at, source in (("2024-01-01 00:00:00", first), ("2024-02-01 00:00:00", later)):
        advance_snapshot(spark, path, lambda previous: snapshot_check(previous, source, ["c_custkey"], run_at))
    return read_snapshot(spark, path).select("c_custkey", "c_name", "c_nationkey", "n_name", "valid_from", "valid_to")


@query("""
select o_orderkey, case when o_orderkey % 40 = 0 then date '2001-07-15' else cast(o_orderdate as date) end as ordered,
       case when o_orderkey % 40 = 0 then o_orderpriority end as priority from orders""")
def upsert_by_key_index(spark, folder):
    """Orders move to another month, with a new column; their former months are found by the index of keys."""
    orders = load(spark, folder, "orders")["orders"].select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"), "o_orderpriority")
    path = new_work_path(spark, "fct_moved")
    merge_months(orders.drop("o_orderpriority"), path, "o_orderkey", "ordered", unique=True)
    moved = orders.withColumn("ordered", F.lit("2001-07-15").cast("date")).withColumnRenamed("o_orderpriority", "priority")
    for rest in (0, 20):  # the first makes the index, the second uses it
        merge_months(moved.filter(f"o_orderkey % 40 = 0 and o_orderkey % 80 = {2 * rest}"), path, "o_orderkey", "ordered", unique=True)
    return read_fact(spark, path)


@query(STORED_SQL + """
select cast(date_trunc('year', o_orderdate) as date) as yearly_date, o_orderstatus, count(*) as orders, round(sum(o_totalprice), 2) as value,
       count(distinct o_custkey) as customers, max(o_totalprice) as most from stored group by 1, 2""")
def refresh_gold_yearly(spark, folder):
    """An aggregate by year with exact distinct counts, refreshed from states by month after an upsert."""
    orders = load(spark, folder, "orders")["orders"]
    fact, gold = new_work_path(spark, "fct_orders"), new_work_path(spark, "agg_yearly")
    spec = GoldSpec("agg_yearly", "fct_orders", "yearly", ("o_orderstatus",), (
        Metric("orders", "COUNT"), Metric("value", "SUM", "o_totalprice"), Metric("customers", "COUNT_DISTINCT", "o_custkey"), Metric("most", "MAX", "o_totalprice")))
    merge_months(_first_orders(orders), fact, "o_orderkey", "o_orderdate")
    refresh_gold(spark, fact, gold, spec, "o_orderdate")
    recent = incremental_filter(orders, "o_orderdate", newest_date(spark, fact, "o_orderdate"))
    months = merge_months(recent, fact, "o_orderkey", "o_orderdate")
    return snap(refresh_gold(spark, fact, gold, spec, "o_orderdate", months=months), value=2)


@query("""
select c_custkey, c_acctbal, 'first' as password, 1 as checksum, timestamp '2024-01-01' as created_at, timestamp '2024-01-01' as valid_from,
       case when c_mktsegment = 'BUILDING' then timestamp '2024-02-01' end as valid_to from customer
union all
select c_custkey, c_acctbal + 1, 'second', 2, timestamp '2024-02-01', timestamp '2024-02-01', null from customer where c_mktsegment = 'BUILDING'""")
def snapshot_ignores_technical(spark, folder):
    """Credentials, checksums and audit stamps change for everybody; versions open where a business column changed."""
    customer = load(spark, folder, "customer")["customer"]

    def state(run_at: str, number: int, word: str, balance):
        return customer.select("c_custkey", balance.alias("c_acctbal"), F.lit(word).alias("password"), F.lit(number).alias("checksum"),
                               F.lit(run_at).cast("timestamp_ntz").alias("created_at"))

    first = state("2024-01-01 00:00:00", 1, "first", F.col("c_acctbal"))
    later = state("2024-02-01 00:00:00", 2, "second", F.col("c_acctbal") + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0))
    snapshot = snapshot_check(None, first, ["c_custkey"], "2024-01-01 00:00:00")
    return snapshot_check(snapshot, later, ["c_custkey"], "2024-02-01 00:00:00")
