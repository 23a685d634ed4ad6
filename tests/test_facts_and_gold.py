import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F, types as T

import sample_queries.catalogue  # noqa: F401  (registers the queries)
from sample_queries.registry import QUERIES
from tests.conftest import rows
from tristrata.functions.columns import is_measure
from tristrata.functions.keys import surrogate_key
from tristrata.operators.dimensions import (
    bridge_join, build_bridge, build_dimension_scd1, dimension_key_columns, is_bridge,
)
from tristrata.operators.facts import build_fact, derived_measures, effective_date, fact_key_columns
from tristrata.operators.gold import build_gold, resolve_gold
from tristrata.operators.star import DimensionLink, star_aggregate
from tristrata.operators.staging import stage, unsupported_columns
from tristrata.plans.specs import (
    Derived, DimensionSpec, FactSpec, ForeignKey, GoldSpec, KeyPath, Metric, TableSpec, unique_names,
)

TO_ORDERS = ForeignKey(("order_id",), "orders", ("order_id",))
TABLES = {
    "customers": TableSpec(("customer_id",)),
    "orders": TableSpec(("order_id",), (ForeignKey(("customer_id",), "customers", ("customer_id",)),)),
    "order_details": TableSpec(("order_id", "product_id"),
                               (TO_ORDERS, ForeignKey(("product_id",), "products", ("product_id",)))),
}
DETAILS = FactSpec(
    "fct_order_details", "order_details", ("order_id", "product_id"), ("quantity", "unit_price", "discount"),
    (Derived("amount", "quantity * unit_price * (1 - discount)"),), date="order_date",
    key_paths=(KeyPath(TO_ORDERS, "customer_id", "customer_id"),),
)


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "customers": spark.createDataFrame(
            [(1, "Ann", "US"), (2, "Bob", None)], "customer_id int, company_name string, country string"),
        "orders": spark.createDataFrame(
            [(10, 1, "2024-01-31", 5.0), (11, None, "2024-02-01", 0.0), (12, 2, None, 1.0)],
            "order_id int, customer_id int, d string, freight double",
        ).select("order_id", "customer_id", F.col("d").cast("date").alias("order_date"), "freight"),
        "order_details": spark.createDataFrame(
            [(10, 1, 2, 10.0, 0.5), (10, 2, 1, 4.0, 0.0), (11, 1, None, 10.0, 0.0), (12, 1, 3, 1.0, 0.0),
             (99, 1, 1, 1.0, None)],
            "order_id int, product_id int, quantity int, unit_price double, discount double"),
    }


def test_staging_types_and_unsupported_columns(spark):
    df = spark.sql("select timestamp'2024-01-01 10:00:00' as at, date'2024-01-01' as d, '2024-02-03' as text, "
                   "array(1) as tags, 1 as n")
    staged = stage(df, {"text": "date"}, drop_types=(T.ArrayType,))
    assert staged.dtypes == [("at", "timestamp_ntz"), ("d", "date"), ("text", "date"), ("n", "int")]
    assert rows(unsupported_columns({"t": df}, (T.ArrayType,))) == [("t", "tags", "array<int>")]
    with pytest.raises(ValueError, match="no such column"):
        stage(df, {"nothing": "date"})


def test_fact_takes_parent_date_and_key(shop):
    fact = build_fact(shop, DETAILS, TABLES)
    assert fact.columns == ["fct_order_details_sk", "order_id", "product_id", "orders_order_date", "quantity",
                            "unit_price", "discount", "amount", "customer_id"]
    assert effective_date(shop, DETAILS, TABLES["order_details"]) == "orders_order_date"
    got = rows(fact, "order_id", "product_id", F.col("orders_order_date").cast("string"), "amount", "customer_id")
    assert got == [(10, 1, "2024-01-31", 10.0, 1), (10, 2, "2024-01-31", 4.0, 1), (11, 1, "2024-02-01", None, None),
                   (12, 1, None, 3.0, 2), (99, 1, None, None, None)]
    expected = shop["order_details"].select(surrogate_key(["order_id", "product_id"])).collect()
    assert {r[0] for r in fact.select("fct_order_details_sk").collect()} == {r[0] for r in expected}


def test_one_join_per_foreign_key_and_role_playing_parents(spark):
    billed = ForeignKey(("billed_to",), "customers", ("customer_id",))
    shipped = ForeignKey(("shipped_to",), "customers", ("customer_id",))
    sources = {
        "customers": spark.createDataFrame([(1, "US", "a"), (2, "FR", "b")], "customer_id int, country string, tier string"),
        "orders": spark.createDataFrame([(7, 1, 2), (8, 2, None)], "order_id int, billed_to int, shipped_to int"),
    }
    spec = FactSpec("fct", "orders", ("order_id",), key_paths=(
        KeyPath(billed, "country", "billed_country"), KeyPath(billed, "tier", "tier"),
        KeyPath(shipped, "country", "shipped_country")))
    fact = build_fact(sources, spec, {"orders": TableSpec(("order_id",), (billed, shipped))})
    assert rows(fact, "order_id", "billed_country", "tier", "shipped_country") == [
        (7, "US", "a", "FR"), (8, "FR", "b", None)]
    assert fact._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_self_reference_and_composite_foreign_key(spark):
    boss = ForeignKey(("boss_id", "site"), "staff", ("id", "site"))
    staff = spark.createDataFrame([(1, "x", None, "head"), (2, "x", 1, "hand"), (3, "y", 1, "hand")],
                                  "id int, site string, boss_id int, title string")
    spec = FactSpec("fct", "staff", ("id",), key_paths=(KeyPath(boss, "title", "boss_title"),))
    fact = build_fact({"staff": staff}, spec, {"staff": TableSpec(("id", "site"), (boss,))})
    assert rows(fact, "id", "site", "boss_title") == [(1, "x", None), (2, "x", "head"), (3, "y", None)]


def test_key_columns_of_junctions_and_periodic_snapshots():
    spec = FactSpec("f", "t", ("a", "b"))
    links = (ForeignKey(("a",), "x", ("a",)), ForeignKey(("b",), "y", ("b",)))
    assert fact_key_columns(spec, TableSpec(("a", "b"), links), "d") == ["a", "b", "d"]
    assert fact_key_columns(spec, TableSpec(("a", "n"), links), "d") == ["a", "n"]
    assert fact_key_columns(replace(spec, dimension_keys=("a", "d")), TableSpec(("n",)), "d") == ["n", "d"]
    assert fact_key_columns(spec, TableSpec(), None) == ["a"]
    assert fact_key_columns(replace(spec, natural_key=("z",)), TableSpec(("a",)), "d") == ["z"]
    with pytest.raises(ValueError, match="identify"):
        fact_key_columns(FactSpec("f", "t"), TableSpec(), None)


def test_derived_measures(shop):
    details = shop["order_details"]
    kept = derived_measures(details, (Derived("a", "quantity * unit_price"), Derived("b", "unit_price*quantity"),
                                      Derived("c", "unit_price / discount")))
    assert list(kept) == ["a", "c"]
    assert rows(details.select(kept["c"].alias("c"))) == [(None,)] * 4 + [(20.0,)]
    with pytest.raises(Exception, match="no_such_column"):
        derived_measures(details, (Derived("a", "no_such_column * 2"),))


def test_audit_dates_come_last_and_extra_dates_are_carried(spark):
    df = spark.sql("select 1 as id, date'2024-01-01' as created_at, date'2024-01-02' as placed, date'2024-01-03' as sent")
    fact = build_fact({"t": df}, FactSpec("f", "t", ("id",)), {"t": TableSpec(("id",))})
    assert fact.columns == ["f_sk", "id", "placed", "sent"]


def test_scd1_dimension_keys(shop):
    orders = shop["orders"]
    assert dimension_key_columns(orders, DimensionSpec("d", "orders"), TABLES["orders"]) == ["order_id"]
    assert dimension_key_columns(orders, DimensionSpec("d", "orders"), replace(TABLES["orders"], primary_key=())) == [
        "customer_id"]
    assert dimension_key_columns(orders, DimensionSpec("d", "orders"), TableSpec()) == ["order_id"]
    dim = build_dimension_scd1(orders, DimensionSpec("dim_orders", "orders", columns=("order_id", "freight")),
                               TABLES["orders"])
    assert dim.columns == ["dim_orders_sk", "order_id", "freight"]


def test_bridges(spark):
    links = (ForeignKey(("product_id",), "p", ("id",)), ForeignKey(("tag_id",), "t", ("id",)))
    pure = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "tag_id int, product_id int")
    assert is_bridge(pure, TableSpec((), links))
    assert is_bridge(pure.withColumn("id", F.lit(1)), TableSpec(("id",), links))
    assert not is_bridge(pure.withColumn("quantity", F.lit(1)), TableSpec((), links))
    assert not is_bridge(pure, TableSpec((), links[:1]))
    bridge = build_bridge(pure)
    assert bridge.columns == ["product_id", "tag_id"]
    tags = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, tag string")
    products = spark.createDataFrame([(5, "p5"), (6, "p6")], "pid int, product string")
    joined = bridge_join(products, bridge, tags, [("pid", "product_id")], [("id", "tag_id")])
    assert rows(joined, "product", "tag") == [("p5", "a"), ("p6", "a")]


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame(
        [("2024-01-07", "a", 1, 1.0), ("2024-01-08", "a", 1, None), ("2024-02-01", "b", 2, 3.0), (None, "b", None, 4.0)],
        "d string, k string, u int, m double").withColumn("d", F.col("d").cast("date"))


def test_gold_groups_and_counts(visits):
    metrics = (Metric("s", "sum", "m"), Metric("rows_of_m", "COUNT", "m"), Metric("rows_of_u", "COUNT", "u"),
               Metric("n", "COUNT"), Metric("users", "COUNT_DISTINCT", "u"), Metric("low", "MIN", "m"))
    gold = build_gold(visits, GoldSpec("g", "f", "weekly", ("k",), metrics, "d"), {"m"})
    assert gold.columns == ["weekly_date", "k", "s", "rows_of_m", "rows_of_u", "n", "users", "low"]
    assert rows(gold, F.col("weekly_date").cast("string"), "k", "s", "rows_of_m", "rows_of_u", "n", "users", "low") == [
        (None, "b", 4.0, 1, 0, 1, 0, 4.0), ("2024-01-01", "a", 1.0, 1, 1, 1, 1, 1.0),
        ("2024-01-08", "a", None, 1, 1, 1, 1, None), ("2024-02-01".replace("02-01", "01-29"), "b", 3.0, 1, 1, 1, 1, 3.0)]
    undated = build_gold(visits, GoldSpec("g", "f", "daily", ("k",), metrics[:1]))
    assert rows(undated) == [("a", 1.0), ("b", 7.0)]
    assert rows(build_gold(visits, GoldSpec("g", "f", "daily", (), metrics[3:4]))) == [(4,)]
    assert rows(build_gold(visits.limit(0), GoldSpec("g", "f", "daily", (), metrics[3:4]))) == [(0,)]


def test_gold_contract(visits):
    broken = GoldSpec("g", "f", "daily", ("k",), (Metric("s", "SUM", "revenue"),), "d")
    with pytest.raises(ValueError, match="derived measures"):
        build_gold(visits, broken, {"m"})
    fixed = resolve_gold(visits, broken, {"m"}, on_unknown="single_measure")
    assert [m.column for m in fixed.metrics] == ["m"]
    with pytest.raises(ValueError, match="derived measures"):
        resolve_gold(visits, broken, {"m", "u"}, on_unknown="single_measure")
    with pytest.raises(ValueError, match="unknown column"):
        build_gold(visits, replace(broken, dimensions=("nope",)), {"m"})
    ytd = GoldSpec("revenue_ytd", "f", "daily", (), (Metric("n", "COUNT"),), "d")
    assert resolve_gold(visits, ytd).grain == "yearly"
    assert resolve_gold(visits, replace(ytd, grain="monthly")).grain == "monthly"
    with pytest.raises(ValueError, match="unknown aggregation"):
        Metric("x", "MEDIAN", "m")


def test_output_names_are_unique():
    named = unique_names((GoldSpec("agg_daily_volume", "fct_orders"), GoldSpec("agg_daily_volume", "fct_lines"),
                          GoldSpec("other", "fct_orders")))
    assert [g.name for g in named] == ["agg_daily_orders_volume", "agg_daily_lines_volume", "other"]
    with pytest.raises(ValueError, match="overwrite"):
        unique_names((GoldSpec("x", "fct_a"), GoldSpec("x", "fct_a")))


def test_star_aggregate_has_one_schema_whatever_the_plan(spark):
    fact = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 3)], "k int, flag string, m int").withColumn("m", F.col("m").cast("decimal(18,2)"))
    dimension = spark.createDataFrame([(1, "s"), (2, "t")], "id int, seg string")
    links = [DimensionLink(dimension, ("k",), ("id",), {"seg": "seg"})]
    metrics = (Metric("s", "SUM", "m"), Metric("a", "AVG", "m"), Metric("n", "COUNT"))
    threshold, found = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        result = star_aggregate(fact, links, ["seg", "flag"], metrics)
        found.append((result.dtypes, rows(result)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found[0] == found[1]
    assert found[0][0][2:4] == [("s", "decimal(28,2)"), ("a", "decimal(22,6)")]


def test_only_bare_names_fall_back_to_the_single_measure(spark):
    fact = spark.createDataFrame([(1, 2)], "m int, n int")
    both = GoldSpec("agg", "f", "daily", (), (Metric("known", "SUM", "m"), Metric("tax", "SUM", "no_such")))
    formula = GoldSpec("agg", "f", "daily", (), (Metric("tax", "SUM", "m * 2"),))
    for spec in (both, formula):
        with pytest.raises(ValueError):
            resolve_gold(fact, spec, {"m"}, on_unknown="single_measure")


def test_words_mark_measures_within_names(spark):
    schema = spark.createDataFrame([], "orderqty int, unitprice int, totalquantity int, account_id int, status int, account int, days_open int").schema
    assert [f.name for f in schema if is_measure(f)] == ["orderqty", "unitprice", "totalquantity", "days_open"]


def test_length_prefixed_keys_do_not_collide(spark):
    source = spark.createDataFrame([("a-b", "c", 1), ("a", "b-c", 2)], "x string, y string, m int")
    keys = [build_fact({"t": source}, FactSpec("fct", "t", (), ("m",), natural_key=("x", "y"), length_prefixed=p), {}).select("fct_sk").distinct().count()
            for p in (False, True)]
    assert keys == [1, 2]


def test_both_keys_of_a_line_need_no_shuffle(spark, tmp_path):
    lines = [(1, 10, 5, 1, 2.0, "2024-01-01 00:00:00"), (1, 10, 5, 1, 2.0, "2024-01-01 00:00:00"), (1, 10, 6, 2, 2.0, "2024-01-01 00:00:00"),
             (2, 11, 5, 1, 3.0, "2024-01-02 00:00:00"), (None, 11, 5, 1, 3.0, "2024-01-02 00:00:00"), (3, 11, None, 1, 3.0, "2024-01-02 00:00:00"),
             (4, 11, 5, 1, None, "2024-01-02 00:00:00"), (5, 11, 5, 1, 3.0, None)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, shipped string")
    df.select("*", F.col("shipped").cast("timestamp").alias("l_shipdate")).drop("shipped").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = QUERIES["fact_keys_with_date"](spark, str(tmp_path))
    md5 = lambda *parts: hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()
    expected = [(md5(o, p, at), md5(s, at)) for o, p, s, _, quantity, at in lines if None not in (o, s, quantity, at)]
    assert sorted((r.fct_lines_sk, r.fct_stock_sk) for r in made.collect()) == sorted(expected)
    assert "Exchange" not in made._jdf.queryExecution().toString()
