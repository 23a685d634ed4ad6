"""The model of the sample tables: declared keys, dimensions, facts, metrics."""

from tristrata.plans.specs import (
    BusinessMetric, Derived, DimensionSpec, Entity, FactSpec, ForeignKey, GoldSpec, KeyPath, Measure, Metric,
    ModelSpec, SemanticModel, TableSpec, TimeDimension,
)

ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations")

TO_ORDERS = ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))
TO_PART = ForeignKey(("l_partkey",), "part", ("p_partkey",))
TO_SUPPLIER = ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))
TO_CUSTOMER = ForeignKey(("o_custkey",), "customer", ("c_custkey",))

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")

TABLES = {
    "region": TableSpec(("r_regionkey",)),
    "nation": TableSpec(("n_nationkey",), (ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
    "customer": TableSpec(("c_custkey",), (ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),)),
    "supplier": TableSpec(("s_suppkey",), (ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),)),
    "part": TableSpec(("p_partkey",)),
    "orders": TableSpec(("o_orderkey",), (TO_CUSTOMER,), not_null=("o_custkey", "o_orderdate")),
    "lineitem": TableSpec(LINE_KEY, (TO_ORDERS, TO_PART, TO_SUPPLIER),
                          not_null=("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")),
    "events": TableSpec(("event_id",), (ForeignKey(("user_id",), "customer", ("c_custkey",)),),
                        not_null=("user_id", "ts"), loaded_at="ts"),
}

NET_REVENUE = Derived("net_revenue", "l_extendedprice * (1 - l_discount)")

FCT_LINEITEM = FactSpec(
    "fct_lineitem", "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"),
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), (NET_REVENUE,), date="l_shipdate",
    key_paths=(KeyPath(TO_ORDERS, "o_custkey", "o_custkey"), KeyPath(TO_ORDERS, "o_orderdate", "o_orderdate")),
    grain="one row per order line",
)
FCT_ORDERS = FactSpec(
    "fct_orders", "orders", ("o_custkey",), ("o_totalprice",), date="o_orderdate",
    key_paths=(KeyPath(TO_CUSTOMER, "c_nationkey", "c_nationkey"),), grain="one row per order",
)
FCT_EVENTS = FactSpec("fct_events", "events", ("user_id", "event_type"), date="ts", factless=True,
                      grain="one row per event")

REVENUE = Metric("revenue", "SUM", "net_revenue")
LINES = Metric("lines", "COUNT")

MODEL = ModelSpec(
    {n: t for n, t in TABLES.items()},
    (DimensionSpec("dim_customer", "customer", 2), DimensionSpec("dim_supplier", "supplier", 2),
     DimensionSpec("dim_part", "part"), DimensionSpec("dim_nation", "nation"), DimensionSpec("dim_region", "region")),
    (FCT_LINEITEM, FCT_ORDERS, FCT_EVENTS),
    (GoldSpec("agg_monthly_revenue", "fct_lineitem", "monthly", ("o_custkey",), (REVENUE, LINES)),
     GoldSpec("agg_daily_orders", "fct_orders", "daily", (), (Metric("order_value", "SUM", "o_totalprice"),)),
     GoldSpec("agg_daily_events", "fct_events", "daily", ("event_type",), (Metric("events", "COUNT"),))),
)

SALES = SemanticModel(
    "sales", "fct_lineitem",
    measures=(Measure("revenue", "sum", "net_revenue"), Measure("quantity", "sum", "l_quantity"),
              Measure("line_count", "count"), Measure("order_count", "count_distinct", "l_orderkey"),
              Measure("average_quantity", "avg", "l_quantity"), Measure("largest_price", "max", "l_extendedprice")),
    time=TimeDimension("ship_date", "l_shipdate", "month"),
    entities=(Entity("line", "fct_lineitem_sk", "primary"),
              Entity("customer", "o_custkey", "foreign", "dim_customer", "c_custkey"),
              Entity("part", "l_partkey", "foreign", "dim_part", "p_partkey")),
    categorical={"return_flag": "l_returnflag"},
)

METRICS = {m.name: m for m in (
    BusinessMetric("total_revenue", "simple", measure="revenue"),
    BusinessMetric("total_quantity", "simple", measure="quantity"),
    BusinessMetric("orders", "simple", measure="order_count"),
    BusinessMetric("mean_quantity", "simple", measure="average_quantity"),
    BusinessMetric("top_price", "simple", measure="largest_price"),
    BusinessMetric("quantity_per_line", "ratio", numerator="quantity", denominator="line_count"),
    BusinessMetric("quantity_to_date", "cumulative", measure="quantity"),
    BusinessMetric("quantity_per_order", "derived", expression="total_quantity / orders",
                   inputs=("total_quantity", "orders")),
)}
