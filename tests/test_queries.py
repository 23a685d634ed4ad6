import os

import pytest

import __spark_entry__ as registered
from sample_queries.compare import canonical, connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    sql = registered.oracle_sql()[name]
    assert differences(spark, connection, FOLDER, registered.queries()[name], sql) is None


def test_comparison_notices_differences(spark, connection):
    wrong = registered.oracle_sql()["gold_global"].replace("count(*)", "count(*) + 1")
    assert differences(spark, connection, FOLDER, registered.queries()["gold_global"], wrong)
    assert canonical(["b", "a"], [(1.0, None)]) == [("NULL", "1")]


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["monthly_date", "o_custkey", "revenue", "lines"] and df.count() > 0
