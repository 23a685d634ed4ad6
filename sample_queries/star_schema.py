"""Staging, dimensions, facts, aggregates and star joins over the sample tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F, types as T

from sample_queries.model import (
    FCT_EVENTS, FCT_LINEITEM, FCT_ORDERS, LINES, REVENUE, TABLES, TO_CUSTOMER,
)
from sample_queries.registry import load, query, snap
from tristrata.functions.scalars import null_to_zero, safe_divide
from tristrata.operators.dimensions import bridge_join, build_bridge, build_dimension_scd1
from tristrata.operators.facts import build_fact
from tristrata.operators.filters import filter_between, filter_recent, filter_year
from tristrata.operators.gold import build_gold
from tristrata.operators.periods import period_change, previous_period, year_to_date
from tristrata.operators.ranking import order_by_period, top_n
from tristrata.operators.staging import stage
from tristrata.operators.star import DimensionLink, cross_fact, star_aggregate, star_join
from tristrata.plans.build import build_model
from tristrata.plans.specs import Derived, DimensionSpec, FactSpec, GoldSpec, Metric, ModelSpec, TableSpec
from tristrata.sources.readers import read_folder, read_partitioned


def lineitem_fact(spark, folder) -> DataFrame:
    return build_fact(load(spark, folder, "lineitem", "orders"), FCT_LINEITEM, TABLES)


def orders_fact(spark, folder) -> DataFrame:
    return build_fact(load(spark, folder, "orders", "customer"), FCT_ORDERS, TABLES)


def lineitem_gold(spark, folder, grain, dimensions=(), metrics=(REVENUE, LINES), date="l_shipdate") -> DataFrame:
    spec = GoldSpec(f"agg_{grain}", "fct_lineitem", grain, dimensions, metrics)
    return build_gold(lineitem_fact(spark, folder), spec, FCT_LINEITEM.measure_names, date)


# The fact in SQL; the queries below select from it.
FACT_SQL = """
with fct as (
  select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
                       cast(l_shipdate as varchar))) as fct_lineitem_sk,
         l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linenumber, l_shipdate, l_quantity, l_extendedprice,
         l_discount, l_tax, l_extendedprice * (1 - l_discount) as net_revenue, o_custkey, o_orderdate
  from lineitem left join orders on l_orderkey = o_orderkey
)"""

MONTHLY_SQL = FACT_SQL + """, monthly as (
  select cast(date_trunc('month', l_shipdate) as date) as monthly_date, sum(l_quantity) as quantity
  from fct group by 1
), monthly_flag as (
  select cast(date_trunc('month', l_shipdate) as date) as monthly_date, l_returnflag, sum(l_quantity) as quantity
  from fct group by 1, 2
)"""


def monthly_quantity(spark, folder, *dimensions) -> DataFrame:
    return lineitem_gold(spark, folder, "monthly", dimensions, (Metric("quantity", "SUM", "l_quantity"),))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as date) as o_orderdate, "
       "o_orderpriority from orders")
def stage_orders(spark, folder):
    return stage(read_folder(spark, folder, ["orders"])["orders"], {"o_orderdate": "date"})


@query("select vec_id, label from embeddings")
def stage_without_arrays(spark, folder):
    """Columns of a type the sink cannot hold are left out."""
    return stage(read_folder(spark, folder, ["embeddings"])["embeddings"], drop_types=(T.ArrayType,))


@query("""select doc_id as id, lang, cast(n_chars as bigint) as n_chars, null as url from documents
          union all by name select page_id as id, url from pages""")
def read_partition_children(spark, folder):
    """Children of one partitioned table, read as one relation; columns some lack are NULL."""
    t = load(spark, folder, "documents", "pages")
    return read_partitioned(spark, children=[
        t["documents"].select(F.col("doc_id").alias("id"), "lang", "n_chars"),
        t["pages"].select(F.col("page_id").alias("id"), "url")])


@query("select md5(cast(p_partkey as varchar)) as dim_part_sk, p_partkey, p_name, p_brand, p_retailprice from part")
def dim_part_scd1(spark, folder):
    spec = DimensionSpec("dim_part", "part", columns=("p_partkey", "p_name", "p_brand", "p_retailprice"))
    return build_dimension_scd1(load(spark, folder, "part")["part"], spec, TABLES["part"])


@query("select md5(coalesce(cast(doc_id as varchar), '_dbt_utils_surrogate_key_null_') || '-' || "
       "coalesce(nullif(lang, 'en'), '_dbt_utils_surrogate_key_null_')) as dim_documents_sk, doc_id, "
       "nullif(lang, 'en') as lang from documents")
def surrogate_key_with_nulls(spark, folder):
    """A composite key, one part of which is NULL in many rows."""
    documents = load(spark, folder, "documents")["documents"].withColumn("lang", F.nullif("lang", F.lit("en")))
    return build_dimension_scd1(documents, DimensionSpec("dim_documents", "documents", columns=("doc_id", "lang")),
                                TableSpec(("doc_id", "lang")))


@query(FACT_SQL + "select * from fct")
def fact_lineitem(spark, folder):
    return lineitem_fact(spark, folder)


@query("""select md5(cast(o_orderkey as varchar)) as fct_orders_sk, o_custkey, o_orderkey, o_orderdate, o_totalprice,
                 c_nationkey
          from orders left join customer on o_custkey = c_custkey""")
def fact_orders_two_hops(spark, folder):
    """A dimension key two foreign keys away: order, customer, nation."""
    return orders_fact(spark, folder)


@query("""select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                               cast(l_partkey as varchar))) as fct_lines_sk,
                 l_orderkey, l_linenumber, l_partkey, o_orderdate as orders_o_orderdate, l_quantity
          from lineitem left join orders on l_orderkey = o_orderkey""")
def fact_parent_date(spark, folder):
    """A fact without a date takes its parent's."""
    sources = load(spark, folder, "lineitem", "orders")
    sources["lineitem"] = sources["lineitem"].drop("l_shipdate")
    key = ("l_orderkey", "l_linenumber", "l_partkey")
    tables = TABLES | {"lineitem": replace(TABLES["lineitem"], primary_key=key)}
    return build_fact(sources, FactSpec("fct_lines", "lineitem", ("l_orderkey",), ("l_quantity",)), tables)


@query("""select cast(ts as date) as daily_date, event_type, count(*) as events, count(distinct user_id) as users
          from events group by 1, 2""")
def fact_factless_events(spark, folder):
    fact = build_fact(load(spark, folder, "events"), FCT_EVENTS, TABLES)
    spec = GoldSpec("agg_daily_events", "fct_events", "daily", ("event_type",),
                    (Metric("events", "COUNT"), Metric("users", "COUNT_DISTINCT", "user_id")))
    return build_gold(fact, spec, FCT_EVENTS.measure_names, "ts")


def _gold_sql(grain: str, unit: str) -> str:
    return FACT_SQL + f"""
select cast(date_trunc('{unit}', l_shipdate) as date) as {grain}_date, round(sum(net_revenue), 4) as revenue,
       count(*) as lines
from fct group by 1"""


@query(_gold_sql("daily", "day"))
def gold_daily_revenue(spark, folder):
    return snap(lineitem_gold(spark, folder, "daily"), revenue=4)


@query(_gold_sql("weekly", "week"))
def gold_weekly_revenue(spark, folder):
    return snap(lineitem_gold(spark, folder, "weekly"), revenue=4)


@query(FACT_SQL + """
select cast(date_trunc('month', l_shipdate) as date) as monthly_date, o_custkey,
       round(sum(net_revenue), 4) as revenue, count(*) as lines
from fct group by 1, 2""")
def gold_monthly_revenue(spark, folder):
    """Net revenue by month and customer, the key carried from the order."""
    return snap(lineitem_gold(spark, folder, "monthly", ("o_custkey",)), revenue=4)


@query(_gold_sql("yearly", "year"))
def gold_yearly_revenue(spark, folder):
    return snap(lineitem_gold(spark, folder, "yearly"), revenue=4)


@query(FACT_SQL + """
select cast(date_trunc('year', l_shipdate) as date) as yearly_date, round(sum(net_revenue), 4) as revenue
from fct group by 1""")
def gold_ytd_becomes_yearly(spark, folder):
    spec = GoldSpec("agg_revenue_ytd", "fct_lineitem", "daily", (), (REVENUE,))
    gold = build_gold(lineitem_fact(spark, folder), spec, FCT_LINEITEM.measure_names, "l_shipdate")
    return snap(gold, revenue=4)


@query(FACT_SQL + """
select cast(date_trunc('month', l_shipdate) as date) as monthly_date, l_returnflag,
       sum(l_quantity) as quantity, avg(l_quantity) as mean_quantity, min(l_extendedprice) as least_price,
       max(l_extendedprice) as greatest_price, count(*) as lines, count(o_custkey) as customer_rows,
       count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts
from fct group by 1, 2""")
def gold_all_aggs(spark, folder):
    return lineitem_gold(spark, folder, "monthly", ("l_returnflag",), (
        Metric("quantity", "SUM", "l_quantity"), Metric("mean_quantity", "AVG", "l_quantity"),
        Metric("least_price", "MIN", "l_extendedprice"), Metric("greatest_price", "MAX", "l_extendedprice"),
        Metric("lines", "COUNT", "*"), Metric("customer_rows", "COUNT", "o_custkey"),
        Metric("orders", "COUNT_DISTINCT", "l_orderkey"), Metric("parts", "COUNT_DISTINCT", "l_partkey")))


@query("""select l_returnflag, count(*) as measure_count, count(nullif(l_discount, 0)) as key_count
          from lineitem group by 1""")
def gold_count_measure_nulls(spark, folder):
    """COUNT of a measure counts rows, NULLs included; COUNT of another column skips NULLs."""
    lines = load(spark, folder, "lineitem")["lineitem"]
    lines = lines.withColumns({"discount": F.nullif("l_discount", F.lit(0.0)),
                               "discount_code": F.nullif("l_discount", F.lit(0.0))})
    spec = GoldSpec("agg_discounts", "lines", "daily", ("l_returnflag",),
                    (Metric("measure_count", "COUNT", "discount"), Metric("key_count", "COUNT", "discount_code")))
    return build_gold(lines, spec, {"discount"})


@query(FACT_SQL + "select l_suppkey, round(sum(net_revenue), 4) as revenue, count(*) as lines from fct group by 1")
def gold_undated(spark, folder):
    return snap(lineitem_gold(spark, folder, "daily", ("l_suppkey",), date=None), revenue=4)


@query(FACT_SQL + "select round(sum(net_revenue), 4) as revenue, count(*) as lines from fct")
def gold_global(spark, folder):
    return snap(lineitem_gold(spark, folder, "daily", date=None), revenue=4)


@query(FACT_SQL + """
select cast(date_trunc('month', l_shipdate) as date) as monthly_date, sum(l_quantity) as total
from fct group by 1""")
def gold_single_measure_remap(spark, folder):
    """A metric on an unknown column falls back to the fact's only measure."""
    lines = load(spark, folder, "lineitem")["lineitem"].select("l_orderkey", "l_shipdate", "l_quantity")
    spec = GoldSpec("agg_total", "lines", "monthly", (), (Metric("total", "SUM", "grand_total"),))
    return build_gold(lines, spec, {"l_quantity"}, "l_shipdate", on_unknown="single_measure")


@query(FACT_SQL + """
select fct_lineitem_sk, l_quantity, c_mktsegment as segment, n_name as nation
from fct left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey""")
def star_join_fact_rows(spark, folder):
    t = load(spark, folder, "customer", "nation")
    joined = star_join(lineitem_fact(spark, folder), [
        DimensionLink(t["customer"], ("o_custkey",), ("c_custkey",),
                      {"segment": "c_mktsegment", "c_nationkey": "c_nationkey"}),
        DimensionLink(t["nation"], ("c_nationkey",), ("n_nationkey",), {"nation": "n_name"})])
    return joined.select("fct_lineitem_sk", "l_quantity", "segment", "nation")


@query(FACT_SQL + """
select n_name as nation, round(sum(net_revenue), 4) as revenue, count(*) as lines
from fct left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by 1""")
def star_join_revenue_by_nation(spark, folder):
    t = load(spark, folder, "customer", "nation")
    links = [DimensionLink(t["customer"], ("o_custkey",), ("c_custkey",), {"c_nationkey": "c_nationkey"}),
             DimensionLink(t["nation"], ("c_nationkey",), ("n_nationkey",), {"nation": "n_name"})]
    return snap(star_aggregate(lineitem_fact(spark, folder), links, ["nation"], (REVENUE, LINES)), revenue=4)


@query("""
select p_brand as brand, l_returnflag, sum(cast(l_quantity as decimal(18, 2))) as quantity, count(*) as lines
from lineitem left join part on l_partkey = p_partkey group by 1, 2""")
def star_aggregate_decimal(spark, folder):
    """Decimal measures by an attribute and a fact column; types and order of columns do not depend on the plan."""
    t = load(spark, folder, "lineitem", "part")
    fact = t["lineitem"].withColumn("q", F.col("l_quantity").cast("decimal(18, 2)"))
    links = [DimensionLink(t["part"], ("l_partkey",), ("p_partkey",), {"brand": "p_brand"})]
    metrics = (Metric("quantity", "SUM", "q"), Metric("lines", "COUNT"))
    return star_aggregate(fact, links, ["brand", "l_returnflag"], metrics)


@query("""
select c_custkey, c_mktsegment, o.orders, o.order_value, e.events
from (select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as order_value from orders group by 1) o
join customer on o.o_custkey = c_custkey
left join (select user_id, count(*) as events from events group by 1) e on c_custkey = e.user_id""")
def cross_fact_orders_events(spark, folder):
    t = load(spark, folder, "orders", "events", "customer")
    return cross_fact(
        t["orders"], t["events"], t["customer"], "o_custkey", "user_id", "c_custkey",
        [F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("order_value")],
        [F.count(F.lit(1)).alias("events")], ["c_mktsegment"])


@query("""
select p_partkey, p_brand, s_suppkey, s_nationkey
from (select distinct l_partkey, l_suppkey from lineitem) b
join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""")
def bridge_part_supplier(spark, folder):
    t = load(spark, folder, "lineitem", "part", "supplier")
    bridge = build_bridge(t["lineitem"].select("l_suppkey", "l_partkey").distinct())
    return bridge_join(t["part"].select("p_partkey", "p_brand"), bridge,
                       t["supplier"].select("s_suppkey", "s_nationkey"),
                       [("p_partkey", "l_partkey")], [("s_suppkey", "l_suppkey")])


@query(MONTHLY_SQL + """
select monthly_date, l_returnflag, quantity,
       lag(quantity) over (partition by l_returnflag order by monthly_date) as previous_period
from monthly_flag""")
def previous_period_by_flag(spark, folder):
    return previous_period(monthly_quantity(spark, folder, "l_returnflag"), "quantity", "monthly_date",
                           ["l_returnflag"])


@query("""
with daily as (select user_id, cast(ts as date) as daily_date, count(*) as events from events group by 1, 2),
spans as (select user_id, unnest(generate_series(min(daily_date), max(daily_date), interval 1 day)) as d
          from daily group by 1)
select s.user_id, cast(d as date) as daily_date, events,
       lag(events) over (partition by s.user_id order by d) as previous_period
from spans s left join daily x on x.user_id = s.user_id and x.daily_date = cast(d as date)""")
def previous_period_filled(spark, folder):
    """Days without events count as periods."""
    spec = GoldSpec("agg_daily", "events", "daily", ("user_id",), (Metric("events", "COUNT"),), "ts")
    daily = build_gold(load(spark, folder, "events")["events"], spec)
    return previous_period(daily, "events", "daily_date", ["user_id"], grain="daily", fill=True).select(
        "user_id", "daily_date", "events", "previous_period")


@query(MONTHLY_SQL + """
select monthly_date, quantity, lag(quantity) over w as previous_period, quantity - lag(quantity) over w as change,
       (quantity - lag(quantity) over w) / nullif(lag(quantity) over w, 0) as growth_rate
from monthly window w as (order by monthly_date)""")
def period_change_monthly(spark, folder):
    return period_change(monthly_quantity(spark, folder), "quantity", "monthly_date")


@query(MONTHLY_SQL + """
select monthly_date, l_returnflag, quantity,
       sum(quantity) over (partition by l_returnflag, year(monthly_date) order by monthly_date
                           rows between unbounded preceding and current row) as year_to_date
from monthly_flag""")
def year_to_date_by_flag(spark, folder):
    return year_to_date(monthly_quantity(spark, folder, "l_returnflag"), "quantity", "monthly_date",
                        ["l_returnflag"])


@query("""select o_custkey, round(sum(o_totalprice), 2) as lifetime_value from orders
          group by 1 order by sum(o_totalprice) desc, o_custkey limit 20""")
def top_n_customers(spark, folder):
    """The report of the 20 most valuable customers."""
    fact = orders_fact(spark, folder)
    return snap(top_n(fact, ["o_custkey"], Metric("lifetime_value", "SUM", "o_totalprice"), 20), lifetime_value=2)


@query(MONTHLY_SQL + "select * from monthly order by monthly_date desc")
def order_by_period_desc(spark, folder):
    return order_by_period(monthly_quantity(spark, folder), "monthly_date", descending=True)


@query(_gold_sql("daily", "day") + " having cast(date_trunc('day', l_shipdate) as date) >= date '2001-06-30' - 30")
def filter_recent_days(spark, folder):
    return snap(filter_recent(lineitem_gold(spark, folder, "daily"), "daily_date", 30, "2001-06-30"), revenue=4)


@query("""select o_orderkey, o_orderdate, o_totalprice from orders
          where o_orderdate between timestamp '1997-01-01' and timestamp '1997-03-31'""")
def filter_between_dates(spark, folder):
    orders = load(spark, folder, "orders")["orders"]
    return filter_between(orders, "o_orderdate", "1997-01-01", "1997-03-31").select(
        "o_orderkey", "o_orderdate", "o_totalprice")


@query("select o_orderkey, o_orderdate, o_totalprice from orders where year(o_orderdate) = 1998")
def filter_calendar_year(spark, folder):
    orders = load(spark, folder, "orders")["orders"]
    return filter_year(orders, "o_orderdate", "1998-05-17").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""select l_orderkey, l_linenumber, l_partkey, l_shipdate,
                 l_extendedprice / nullif(l_discount, 0) as price_per_discount,
                 coalesce(l_extendedprice / nullif(l_discount, 0), 0) as price_or_zero from lineitem""")
def safe_divide_zero_discount(spark, folder):
    ratio = safe_divide("l_extendedprice", "l_discount")
    return load(spark, folder, "lineitem")["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", ratio.alias("price_per_discount"),
        null_to_zero(ratio).alias("price_or_zero"))


@query("""select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                               cast(l_partkey as varchar), cast(l_shipdate as varchar))) as fct_rates_sk,
                 l_partkey, l_orderkey, l_linenumber, l_shipdate,
                 l_extendedprice / nullif(l_discount, 0) as per_discount,
                 case when l_tax > 0.04 then l_quantity else 0 end as taxed_quantity
          from lineitem""")
def derived_measures_guarded(spark, folder):
    """Division by a zero column gives NULL; a repeated formula is dropped."""
    spec = FactSpec("fct_rates", "lineitem", ("l_partkey",), derived=(
        Derived("per_discount", "l_extendedprice / l_discount"),
        Derived("taxed_quantity", "case when l_tax > 0.04 then l_quantity else 0 end"),
        Derived("again", "l_extendedprice/l_discount")))
    return build_fact(load(spark, folder, "lineitem"), spec, {"lineitem": replace(TABLES["lineitem"], foreign_keys=())})


@query("""
select 'agg_monthly_lines_volume' as aggregate, cast(date_trunc('month', o_orderdate) as date) as monthly_date, l_returnflag as kind, sum(l_quantity) as volume
from lineitem left join orders on o_orderkey = l_orderkey group by 2, 3
union all
select 'agg_monthly_orders_volume', cast(date_trunc('month', o_orderdate) as date), o_orderstatus, cast(count(*) as double) from orders group by 2, 3""")
def gold_of_one_name_on_parent_date(spark, folder):
    """Two aggregates of one name, told apart by their facts; the fact of the first has its parent's date only."""
    t = load(spark, folder, "lineitem", "orders")
    lines = FactSpec("fct_lines", "lineitem", ("l_returnflag",), ("l_quantity",), natural_key=("l_orderkey", "l_linenumber", "l_partkey"))
    orders = FactSpec("fct_orders", "orders", ("o_custkey", "o_orderstatus"), ("o_totalprice",), date="o_orderdate")
    name = "agg_monthly_volume"
    gold = (GoldSpec(name, "fct_lines", "monthly", ("l_returnflag",), (Metric("volume", "SUM", "l_quantity"),)),
            GoldSpec(name, "fct_orders", "monthly", ("o_orderstatus",), (Metric("volume", "COUNT"),)))
    keyed = replace(TABLES["lineitem"], primary_key=("l_orderkey", "l_linenumber", "l_partkey"))
    model = ModelSpec({"lineitem": keyed, "orders": TABLES["orders"]}, (), (lines, orders), gold)
    built = build_model({"lineitem": t["lineitem"].drop("l_shipdate"), "orders": t["orders"]}, model, "2024-01-01 00:00:00")
    found = [built.tables[n].select(F.lit(n).alias("aggregate"), "monthly_date", F.col(kind).alias("kind"), F.col("volume").cast("double").alias("volume"))
             for n, kind in (("agg_monthly_lines_volume", "l_returnflag"), ("agg_monthly_orders_volume", "o_orderstatus"))]
    return found[0].unionByName(found[1])


@query(MONTHLY_SQL + "select * from monthly order by monthly_date desc limit 5")
def newest_periods(spark, folder):
    """The five newest months of an aggregate."""
    return order_by_period(monthly_quantity(spark, folder), "monthly_date", descending=True, limit=5)


@query("""
select md5(cast(o_orderkey as varchar)) as fct_sales_sk, o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderdate + interval 3 day as paid_on,
       cast(o_orderdate + interval 9 day as date) as delivered_on from orders""")
def fact_extra_dates(spark, folder):
    """A fact carries all further dates of its source, but no audit stamp."""
    orders = load(spark, folder, "orders")["orders"].select(
        "*", F.expr("o_orderdate + interval 3 days").alias("paid_on"), F.expr("cast(o_orderdate + interval 9 days as date)").alias("delivered_on"),
        F.col("o_orderdate").alias("updated_at"))
    return build_fact({"sales": orders}, FactSpec("fct_sales", "sales", ("o_custkey",), ("o_totalprice",), date="o_orderdate"), {"sales": TABLES["orders"]})


@query("""
select md5(concat_ws('-', cast(l_orderkey as varchar), cast(l_partkey as varchar), cast(l_shipdate as varchar))) as fct_lines_sk, l_orderkey, l_partkey, l_shipdate, l_quantity,
       md5(concat_ws('-', cast(l_suppkey as varchar), cast(l_shipdate as varchar))) as fct_stock_sk from lineitem""")
def fact_keys_with_date(spark, folder):
    """The date joins the key of a junction, all of whose key columns refer to others, and of a periodic snapshot."""
    lines = load(spark, folder, "lineitem")["lineitem"]
    junction = replace(TABLES["lineitem"], primary_key=("l_orderkey", "l_partkey"))
    # The second key is made of the rows that the first one is made of, so both stand on a line without any join.
    carried = ("l_orderkey", "l_partkey", "l_quantity")
    periodic = FactSpec("fct_stock", "stock", ("l_suppkey", "l_shipdate", *carried), date="l_shipdate", factless=True)
    stock = build_fact({"stock": lines}, periodic, {"stock": TableSpec(("l_suppkey",))})
    fact = FactSpec("fct_lines", "lines", ("l_orderkey", "l_partkey", "l_suppkey", "fct_stock_sk"), ("l_quantity",), date="l_shipdate")
    by_pair = build_fact({"lines": stock}, fact, {"lines": junction})
    whole = by_pair.filter(" and ".join(f"{c} is not null" for c in (*carried, "l_suppkey", "l_shipdate")))
    return whole.select("fct_lines_sk", "l_orderkey", "l_partkey", "l_shipdate", "l_quantity", "fct_stock_sk")
