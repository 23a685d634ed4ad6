import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.functions.columns import check_columns, date_columns, is_measure, update_stamp
from tristrata.functions.keys import NULL_MARKER, surrogate_key
from tristrata.functions.scalars import guard_division, null_to_zero, safe_divide, to_grain


@pytest.mark.parametrize("expression, guarded", [
    ("a / b", "a / nullif(b, 0)"),
    ("a/b*c / t.d", "a/ nullif(b, 0)*c / nullif(t.d, 0)"),
    ("a / `odd name`", "a / nullif(`odd name`, 0)"),
    ("a / 100", "a / 100"),
    ("a / coalesce(b, 1)", "a / coalesce(b, 1)"),
    ("concat(a, ' / b')", "concat(a, ' / b')"),
])
def test_guard_division(expression, guarded):
    assert guard_division(expression).replace("/nullif", "/ nullif") == guarded
    assert guard_division(guard_division(expression)) == guard_division(expression)


def test_safe_divide_and_null_to_zero(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (3, None)], "a int, b int")
    out = df.select(safe_divide("a", "b").alias("q"), null_to_zero(safe_divide("a", "b")).alias("z"))
    assert [tuple(r) for r in out.collect()] == [(0.5, 0.5), (None, 0.0), (None, 0.0), (None, 0.0)]
    assert df.select(F.expr(guard_division("a / b")).alias("q")).collect()[1]["q"] is None


def test_grains_at_week_and_year_boundary(spark):
    df = spark.createDataFrame([("2023-12-31 23:59:59",), ("2024-01-01 00:00:00",), (None,)], "t string")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = df.select(*(to_grain("t", g).cast("string").alias(g) for g in ("day", "weekly", "month", "yearly")))
    assert [tuple(r) for r in out.collect()] == [
        ("2023-12-31", "2023-12-25", "2023-12-01", "2023-01-01"),
        ("2024-01-01", "2024-01-01", "2024-01-01", "2024-01-01"), (None,) * 4]
    with pytest.raises(ValueError, match="unknown grain"):
        to_grain("t", "hourly")


def test_surrogate_key(spark):
    df = spark.createDataFrame([(1, "x"), (1, None), (None, None)], "a int, b string")
    expected = [hashlib.md5(t.encode()).hexdigest()
                for t in ("1-x", f"1-{NULL_MARKER}", f"{NULL_MARKER}-{NULL_MARKER}")]
    assert [r[0] for r in df.select(surrogate_key(["a", "b"])).collect()] == expected


def test_length_prefixed_key_does_not_collide(spark):
    df = spark.createDataFrame([("a-b", "c"), ("a", "b-c")], "a string, b string")
    assert df.select(surrogate_key(["a", "b"])).distinct().count() == 1
    assert df.select(surrogate_key(["a", "b"], length_prefixed=True)).distinct().count() == 2


def test_column_kinds(spark):
    df = spark.createDataFrame([], "id int, created_at timestamp, due date, account int, item_count int, price double, "
                                   "photo binary, updated_on timestamp, note string")
    assert date_columns(df) == ["due", "created_at", "updated_on"]
    assert date_columns(df, audit=False) == ["due"]
    assert [f.name for f in df.schema if is_measure(f)] == ["item_count", "price"]
    assert update_stamp(df) == "updated_on"
    assert check_columns(df, ["id"]) == ["due", "account", "item_count", "price", "note"]
    assert check_columns(df.select("id", "photo"), ["id"]) == ["photo"]
    assert rows(df) == []
