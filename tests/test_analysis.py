from datetime import date, datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.operators.filters import filter_between, filter_current, filter_recent, filter_year
from tristrata.operators.metrics import query_metric
from tristrata.operators.periods import cumulative, period_change, previous_period, year_to_date
from tristrata.operators.profiling import discover_composite_fks
from tristrata.operators.quality import check_freshness, check_not_null, check_relationships, check_table, check_unique
from tristrata.operators.ranking import order_by_period, top_n
from tristrata.operators.star import DimensionLink, cross_fact, star_aggregate, star_join
from tristrata.plans.specs import BusinessMetric, Entity, Measure, Metric, SemanticModel, TimeDimension


@pytest.fixture(scope="module")
def monthly(spark):
    return spark.createDataFrame(
        [("2023-11-01", "a", 10), ("2023-12-01", "a", 0), ("2024-02-01", "a", 5), ("2024-02-01", "b", 7)],
        "d string, k string, m int").withColumn("d", F.col("d").cast("date"))


def test_periods(monthly):
    month = F.month("d")
    assert rows(previous_period(monthly, "m", "d", ["k"]), "k", month, "previous_period") == [
        ("a", 11, None), ("a", 12, 10), ("a", 2, 0), ("b", 2, None)]
    filled = previous_period(monthly, "m", "d", ["k"], grain="monthly", fill=True)
    assert rows(filled, "k", month, "m", "previous_period") == [
        ("a", 1, None, 0), ("a", 11, 10, None), ("a", 12, 0, 10), ("a", 2, 5, None), ("b", 2, 7, None)]
    change = period_change(monthly, "m", "d", ["k"])
    assert rows(change, "k", month, "change", "growth_rate") == [
        ("a", 11, None, None), ("a", 12, -10, -1.0), ("a", 2, 5, None), ("b", 2, None, None)]
    assert rows(cumulative(monthly, "m", "d", ["k"]), "k", month, "cumulative") == [
        ("a", 11, 10), ("a", 12, 10), ("a", 2, 15), ("b", 2, 7)]
    assert rows(year_to_date(monthly, "m", "d", ["k"]), "k", month, "year_to_date") == [
        ("a", 11, 10), ("a", 12, 10), ("a", 2, 5), ("b", 2, 7)]
    with pytest.raises(ValueError, match="grain"):
        previous_period(monthly, "m", "d", fill=True)


def test_filters(monthly):
    day = F.col("d").cast("string")
    assert rows(filter_recent(monthly, "d", 62, "2024-02-01"), day, "k") == [
        ("2023-12-01", "a"), ("2024-02-01", "a"), ("2024-02-01", "b")]
    assert rows(filter_between(monthly, "d", "2023-11-01", date(2023, 12, 1)), day) == [("2023-11-01",), ("2023-12-01",)]
    assert rows(filter_year(monthly, "d", "2023-06-06"), day) == [("2023-11-01",), ("2023-12-01",)]
    assert filter_recent(monthly, "d").count() == 0
    current = monthly.withColumn("is_current", F.col("m") > 5)
    assert filter_current(current).count() == 2


def test_ranking(monthly):
    assert [tuple(r) for r in top_n(monthly, ["d"], Metric("s", "SUM", "m"), 2).collect()] == [
        (date(2024, 2, 1), 12), (date(2023, 11, 1), 10)]
    ties = top_n(monthly.withColumn("m", F.lit(1)), ["d", "k"], Metric("n", "COUNT"), 2).collect()
    assert [r["d"] for r in ties] == [date(2023, 11, 1), date(2023, 12, 1)]
    assert [r["m"] for r in order_by_period(monthly.filter("k = 'a'"), "d", True, 2).collect()] == [5, 0]


@pytest.fixture(scope="module")
def sales(spark):
    return {
        "fct": spark.createDataFrame(
            [(1, 10, "2024-01-05", 2.0, 4.0), (1, 11, "2024-01-09", 3.0, 0.0), (2, 11, "2024-02-01", 5.0, 2.0),
             (9, 12, "2024-02-02", 1.0, None), (None, 12, None, 7.0, 1.0)],
            "customer_id int, order_id int, d string, amount double, cost double",
        ).withColumn("d", F.col("d").cast("date")),
        "dim_customer": spark.createDataFrame(
            [(1, "US", 7, True), (2, "FR", 8, True), (1, "DE", 8, False)], "id int, country string, region int, is_current boolean"),
        "dim_region": spark.createDataFrame([(7, "west"), (8, "east")], "rid int, region_name string"),
    }


def test_star_join_keeps_unmatched_and_chains(sales):
    current = sales["dim_customer"].filter("is_current")
    joined = star_join(sales["fct"], [
        DimensionLink(current, ("customer_id",), ("id",), {"country": "country", "region": "region"}),
        DimensionLink(sales["dim_region"], ("region",), ("rid",), {"region_name": "region_name"})])
    assert rows(joined, "customer_id", "amount", "country", "region_name") == [
        (None, 7.0, None, None), (1, 2.0, "US", "west"), (1, 3.0, "US", "west"), (2, 5.0, "FR", "east"),
        (9, 1.0, None, None)]


@pytest.fixture(params=["10485760", "-1"], ids=["broadcast", "too_large"])
def threshold(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_dimensions_are_joined_to_reduced_facts(spark, tmp_path, threshold):
    spark.range(1000).withColumn("v", F.lit(1)).write.parquet(str(tmp_path / "f"))
    spark.range(1000).withColumn("a", F.lit("x")).write.parquet(str(tmp_path / "d"))
    link = DimensionLink(spark.read.parquet(str(tmp_path / "d")), ("id",), ("id",), {"a": "a"})
    out = star_aggregate(spark.read.parquet(str(tmp_path / "f")), [link], ["a"], (Metric("s", "SUM", "v"),))
    assert rows(out) == [("x", 1000)]
    join, *above = [line for line in reversed(out._jdf.queryExecution().optimizedPlan().toString().splitlines())
                    if "Aggregate" in line or "Join" in line]
    assert ("Join" in join) == (threshold > 0)  # the lowest of the two nodes


def test_star_aggregate_with_chained_links(sales, threshold):
    links = [DimensionLink(sales["dim_customer"].filter("is_current"), ("customer_id",), ("id",), {"region": "region"}),
             DimensionLink(sales["dim_region"], ("region",), ("rid",), {"region_name": "region_name"})]
    out = star_aggregate(sales["fct"], links, ["region_name", F.month("d").alias("m")],
                         (Metric("s", "SUM", "amount"), Metric("n", "COUNT", "cost"), Metric("nc", "COUNT", "amount")),
                         measures=("cost",))
    assert rows(out, "region_name", "m", "s", "n", "nc") == [
        (None, None, 7.0, 1, 1), (None, 2, 1.0, 1, 1), ("east", 2, 5.0, 1, 1), ("west", 1, 5.0, 2, 2)]


@pytest.mark.parametrize("linked", [True, False])
def test_star_aggregate_equals_join_then_group(sales, linked, threshold):
    current = sales["dim_customer"].filter("is_current")
    links = [DimensionLink(current, ("customer_id",), ("id",), {"country": "country"})] if linked else []
    metrics = (Metric("s", "SUM", "amount"), Metric("n", "COUNT"), Metric("nc", "COUNT", "cost"),
               Metric("o", "COUNT_DISTINCT", "order_id"), Metric("a", "AVG", "cost"), Metric("lo", "MIN", "amount"),
               Metric("hi", "MAX", "amount"))
    got = star_aggregate(sales["fct"], links, ["country"] if linked else [], metrics)
    expected = star_join(sales["fct"], links).groupBy(*(["country"] if linked else [])).agg(
        F.sum("amount"), F.count(F.lit(1)), F.count("cost"), F.count_distinct("order_id"), F.avg("cost"), F.min("amount"),
        F.max("amount"))
    assert rows(got) == rows(expected)


def test_star_aggregate_of_distinct_counts_only(sales, threshold):
    current = sales["dim_customer"].filter("is_current")
    links = [DimensionLink(current, ("customer_id",), ("id",), {"country": "country"})]
    got = star_aggregate(sales["fct"], links, ["country"], (Metric("o", "COUNT_DISTINCT", "order_id"),))
    assert rows(got, "country", "o") == [(None, 1), ("FR", 1), ("US", 2)]


def test_cross_fact_does_not_multiply(sales, spark):
    visits = spark.createDataFrame([(1,), (1,), (1,), (9,)], "visitor int")
    current = sales["dim_customer"].filter("is_current")
    out = cross_fact(sales["fct"], visits, current, "customer_id", "visitor", "id", [F.sum("amount").alias("amount")],
                     [F.count(F.lit(1)).alias("visits")], ["country"])
    assert rows(out) == [(1, "US", 5.0, 3), (2, "FR", 5.0, None)]


SALES = SemanticModel(
    "sales", "fct", (Measure("amount", "sum", "amount"), Measure("margin", "sum", "amount - cost"),
                     Measure("lines", "count"), Measure("per_cost", "max", "amount / cost")),
    TimeDimension("day", "d", "month"), (Entity("customer", "customer_id", "foreign", "dim_customer", "id"),
                                         Entity("order", "order_id", "primary")), {"big": "amount > 2"})
METRICS = {m.name: m for m in (
    BusinessMetric("revenue", "simple", measure="amount"), BusinessMetric("best", "simple", measure="per_cost"),
    BusinessMetric("share", "ratio", numerator="margin", denominator="amount"),
    BusinessMetric("running", "cumulative", measure="amount"),
    BusinessMetric("doubled", "derived", expression="revenue * 2 / lines_total", inputs=("revenue", "lines_total")),
    BusinessMetric("lines_total", "simple", measure="lines"),
    BusinessMetric("nested", "derived", expression="doubled + revenue", inputs=("doubled", "revenue")))}


def test_metrics(sales, threshold):
    def ask(names, grain=None, by=()):
        return rows(query_metric(sales, SALES, METRICS, names, grain, by))

    assert ask(["revenue", "share"]) == [(18.0, (2 - 4 + 3 + 5 - 2 + 7 - 1) / 18)]
    assert ask(["best"]) == [(7.0,)]  # amount / 0 is NULL, not an error
    assert ask(["revenue"], None, ["customer__country"]) == [(None, 8.0), ("FR", 5.0), ("US", 5.0)]
    assert ask(["revenue"], None, ["big"]) == [(False, 3.0), (True, 15.0)]
    assert ask(["revenue"], None, ["customer"]) == [(None, 7.0), (1, 5.0), (2, 5.0), (9, 1.0)]
    assert [r[1:] for r in ask(["running", "nested"], "default")] == [(7.0, 21.0), (12.0, 5 + 5.0), (18.0, 6 + 6.0)]
    assert query_metric(sales, SALES, METRICS, ["running"], "weekly").columns == ["weekly_date", "running"]
    with pytest.raises(ValueError, match="needs a grain"):
        ask(["running"])
    with pytest.raises(ValueError, match="unknown metric"):
        ask(["nothing"])
    with pytest.raises(ValueError, match="unknown dimension"):
        ask(["revenue"], None, ["planet"])
    with pytest.raises(ValueError, match="lacks its parameters"):
        BusinessMetric("x", "ratio", numerator="a")
    loop = METRICS | {"doubled": BusinessMetric("doubled", "derived", expression="nested", inputs=("nested",))}
    with pytest.raises(ValueError, match="derived from itself"):
        query_metric(sales, SALES, loop, ["nested"])


def test_checks(spark, sales):
    fct = sales["fct"]
    assert rows(check_unique(fct, "fct", ["customer_id"])) == [("fct", "unique", "customer_id", 1, "fail")]
    assert rows(check_unique(fct.limit(0), "fct", ["customer_id"])) == [("fct", "unique", "customer_id", 0, "pass")]
    nulls = spark.createDataFrame([(None, None), (None, None), (1, None), (1, None)], "a int, b int")
    assert check_unique(nulls, "n", ["a", "b"]).first()["failures"] == 1
    assert rows(check_not_null(fct, "fct", ["cost", "order_id"])) == [
        ("fct", "not_null", "cost", 1, "fail"), ("fct", "not_null", "order_id", 0, "pass")]
    current = sales["dim_customer"].filter("is_current")
    assert rows(check_relationships(fct, "fct", ["customer_id"], current, ["id"])) == [
        ("fct", "relationships", "customer_id", 1, "fail")]


@pytest.mark.parametrize("as_of, status", [
    ("2024-01-02 00:00:00", "pass"), ("2024-01-02 00:00:01", "warn"), ("2024-01-03 00:00:00", "warn"),
    ("2024-01-03 00:00:01", "error")])
def test_freshness_limits(spark, as_of, status):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (None,)], "t timestamp_ntz")
    assert check_freshness(df, "t", "t", as_of).first()["status"] == status
    assert check_freshness(df.limit(0), "t", "t", as_of).first()["status"] == "error"


def test_checks_of_a_table_in_one_pass_equal_single_checks(spark, tmp_path):
    fct = spark.createDataFrame([(1, 1, None, "x"), (1, 2, 1, "x"), (2, None, 1, None), (None, None, 9, "y"), (None, 1, None, "y"), (4, 7, 7, "z"), (4, 7, 7, "z")],
                                "a int, b int, c int, s string")
    dim = spark.createDataFrame([(1, "x"), (2, "x"), (9, "y"), (9, "y")], "id bigint, name string")
    fct.write.parquet(str(tmp_path / "fct"))
    dim.write.parquet(str(tmp_path / "dim"))
    fct, dim = spark.read.parquet(str(tmp_path / "fct")), spark.read.parquet(str(tmp_path / "dim"))
    links = [(("b",), "dim", ("id",)), (("c",), "dim", ("id",)), (("c", "s"), "dim", ("id", "name"))]
    one = check_table(fct, "f", [["a"], ["a", "b"], ["b", "a"], ["s"]], ["a", "c"], links, {"dim": dim})
    apart = [check_unique(fct, "f", u) for u in (["a"], ["a", "b"], ["b", "a"], ["s"])] + [check_not_null(fct, "f", ["a", "c"])]
    apart += [check_relationships(fct, "f", columns, dim, key) for columns, _, key in links]
    assert rows(one) == rows(reduce(lambda a, b: a.unionByName(b), apart))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet") == 2
    empty = check_table(fct.limit(0), "f", [["a"]], ["a"], links, {"dim": dim.limit(0)})
    assert {r.failures for r in empty.collect()} == {0} and empty.count() == 5


def test_composite_references_are_found_by_data_alone(spark):
    lines = [(o, n, f"2024-01-{1 + o % 9:02d}") for o in range(1, 40) for n in range(1, 1 + o % 5)]
    orders = spark.createDataFrame(lines, "order_id int, line_no int, day string")
    returns = spark.createDataFrame([(i, n, o) for i, (o, n, _) in enumerate(lines[::3])] + [(900, None, 7), (901, 2, None)], "id int, line_no bigint, order_id bigint")
    # Every column lies in a column of the key, but not the pairs.
    strangers = spark.createDataFrame([(5 * k + 1, 1 + k % 4) for k in range(1, 7)], "order_id int, line_no int")
    tables = {"orders": orders, "returns": returns, "strangers": strangers}
    keys = {"orders": [("order_id", "line_no")], "returns": [("id",)]}
    found = discover_composite_fks(tables, keys).collect()
    assert [(r.child_table, r.child_columns, r.parent_table, r.parent_columns, r.child_distinct, r.parent_distinct, r.evidence, r.rank) for r in found] == [
        ("returns", ["order_id", "line_no"], "orders", ["order_id", "line_no"], len(lines[::3]), len(lines), "name", 1)]
    assert discover_composite_fks(tables, {"returns": [("id",)]}).collect() == []
    three = orders.withColumnsRenamed({"order_id": "a", "line_no": "b", "day": "c"})
    wide = discover_composite_fks({"orders": orders, "part": three.filter("a > 9")}, {"orders": [("order_id", "line_no", "day")]}).collect()
    assert [(r.child_columns, r.parent_columns, r.evidence) for r in wide] == [(["a", "b", "c"], ["order_id", "line_no", "day"], "containment only")]
