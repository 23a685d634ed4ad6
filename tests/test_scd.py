from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.operators import hotkeys
from tristrata.operators.dedup import dedup_latest
from tristrata.operators.diff import change_rate, table_diff
from tristrata.operators.dimensions import build_dimension_scd2
from tristrata.operators.scd import scd2_from_history, snapshot_check, snapshot_timestamp
from tristrata.operators.star import scd2_asof_join, scd2_current_join
from tristrata.plans.specs import DimensionSpec, TableSpec

SOURCE = "id int, name string, last_update string"


def at(day: int) -> datetime:
    return datetime(2024, 1, 1) + timedelta(days=day)


def versions(df):
    return rows(df, "id", "name", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


def test_snapshot_check_life_of_keys(spark):
    first = snapshot_check(None, spark.createDataFrame([(1, "a", "t0"), (2, None, "t0"), (3, "c", "t0")], SOURCE),
                           ["id"], at(0))
    second = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1"), (4, "d", "t1")], SOURCE)
    snapshot = snapshot_check(first, second, ["id"], at(1))
    expected = [(1, "a", "2024-01-01 00:00:00", None),  # only an audit stamp changed
                (2, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, "b", "2024-01-02 00:00:00", None),
                (3, "c", "2024-01-01 00:00:00", None), (4, "d", "2024-01-02 00:00:00", None)]
    assert versions(snapshot) == expected
    assert versions(snapshot_check(snapshot, second, ["id"], at(2))) == expected
    closed = snapshot_check(first, second, ["id"], at(1), close_missing=True)
    assert (3, "c", "2024-01-01 00:00:00", "2024-01-02 00:00:00") in versions(closed)
    third = snapshot_check(snapshot, second.withColumn("name", F.lit(None).cast("string")), ["id"], at(3))
    assert [v for v in versions(third) if v[0] == 2] == [
        (2, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, None, "2024-01-04 00:00:00", None),
        (2, "b", "2024-01-02 00:00:00", "2024-01-04 00:00:00")]


def test_snapshot_with_null_key_is_stable(spark):
    source = spark.createDataFrame([(None, "x", "t")], SOURCE)
    snapshot = snapshot_check(None, source, ["id"], at(0))
    assert versions(snapshot_check(snapshot, source, ["id"], at(1))) == [(None, "x", "2024-01-01 00:00:00", None)]


def test_snapshot_takes_one_row_per_key(spark):
    source = spark.createDataFrame([(1, "a", "t1"), (1, "b", "t2"), (None, "x", "t1"), (None, "y", "t2")], SOURCE)
    snapshot = snapshot_check(None, source, ["id"], at(0), order_by=["last_update"])
    expected = [(None, "y", "2024-01-01 00:00:00", None), (1, "b", "2024-01-01 00:00:00", None)]
    assert versions(snapshot) == expected
    assert versions(snapshot_check(snapshot, source, ["id"], at(1), order_by=["last_update"])) == expected


def test_snapshot_timestamp(spark):
    def state(*values):
        return spark.createDataFrame(list(values), "id int, name string, updated_at timestamp_ntz")

    first = snapshot_timestamp(None, state((1, "a", at(0)), (2, "b", at(0))), ["id"], "updated_at")
    after = snapshot_timestamp(first, state((1, "a", at(1)), (2, "changed", at(0)), (3, "n", None)), ["id"], "updated_at")
    assert versions(after) == [(1, "a", "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (1, "a", "2024-01-02 00:00:00", None),
                               (2, "b", "2024-01-01 00:00:00", None), (3, "n", None, None)]
    with pytest.raises(ValueError, match="run_at"):
        snapshot_timestamp(first, state(), ["id"], "updated_at", close_missing=True)


def test_scd2_dimension_columns(spark):
    snapshot = snapshot_check(None, spark.createDataFrame([(1, "a", "t0")], SOURCE), ["id"], at(0))
    dim = build_dimension_scd2(snapshot, DimensionSpec("dim_x", "x", 2, ("id", "name")), TableSpec(("id",)))
    assert dim.columns == ["dim_x_sk", "id", "name", "valid_from", "valid_to", "is_current"]
    assert dim.first()["is_current"] is True


HISTORY = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40), st.sampled_from(["a", "b", None])), min_size=1,
                   max_size=40)
LIGHT = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@LIGHT
@given(HISTORY)
def test_history_equals_folded_snapshots(spark, changes):
    """All versions at once are what one snapshot per instant would have built."""
    latest = {(k, h): v for k, h, v in changes}
    log = spark.createDataFrame([(k, at(0) + timedelta(hours=7 * h), v) for (k, h), v in latest.items()],
                                "id int, ts timestamp_ntz, name string")
    expected, opened = [], {}
    for (k, h), v in sorted(latest.items(), key=lambda item: item[0][1]):
        when = at(0) + timedelta(hours=7 * h)
        if k not in opened or opened[k][1] != v:
            if k in opened:
                expected.append((k, opened[k][1], str(opened[k][0]), str(when)))
            opened[k] = (when, v)
    expected += [(k, v, str(when), None) for k, (when, v) in opened.items()]
    expected.sort(key=lambda r: [(v is not None, str(v)) for v in r])
    for limit in (None, 2, 0):
        assert versions(scd2_from_history(log, ["id"], "ts", ["name"], hot_key_rows=limit)) == expected


def test_history_ties_and_null_keys(spark):
    log = spark.createDataFrame(
        [(1, at(0), "a", 1), (1, at(0), "b", 2), (None, at(0), "x", 1), (None, at(1), "x", 1), (None, at(2), "y", 1)],
        "id int, ts timestamp_ntz, name string, seq int")
    for limit in (None, 1):
        got = versions(scd2_from_history(log, ["id"], "ts", ["name"], ["seq"], hot_key_rows=limit))
        assert got == [(None, "x", "2024-01-01 00:00:00", "2024-01-03 00:00:00"),
                       (None, "y", "2024-01-03 00:00:00", None), (1, "b", "2024-01-01 00:00:00", None)]


def test_a_hot_key_within_one_second_is_dealt_to_several_tasks(spark):
    start, n = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 40_000
    log = spark.range(n).select(
        F.lit(7).alias("id"), F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / {n}.0)").alias("ts"),
        (F.col("id") % 3 == 0).cast("string").alias("name")).unionByName(
        spark.range(9).select(F.col("id").cast("int"), start.alias("ts"), F.lit("x").alias("name")))
    plain = scd2_from_history(log, ["id"], "ts", ["name"], hot_key_rows=None)
    cut = scd2_from_history(log, ["id"], "ts", ["name"], hot_key_rows=1000)
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty() and cut.count() > 20_000
    hot = hotkeys.hot_keys(log, ["id"], 1000)
    pieces = hotkeys.in_pieces(log, hotkeys.bounds_of(log, hot, ["id"], "ts"), ["id"], "ts").groupBy(hotkeys.PIECE).count().collect()
    assert len(pieces) == hotkeys.PIECES and max(p["count"] for p in pieces) < 3 * n / hotkeys.PIECES


def test_no_job_runs_while_the_plan_is_made(spark):
    log = spark.range(100).selectExpr("id % 3 as id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "'a' as name")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    scd2_from_history(log, ["id"], "ts", ["name"], hot_key_rows=5)
    assert set(tracker.getJobIdsForGroup(None)) == before


@LIGHT
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30)), min_size=1, max_size=12, unique=True),
       st.lists(st.tuples(st.sampled_from([1, 2, 3, None]), st.one_of(st.none(), st.integers(0, 30))), min_size=1,
                max_size=15))
def test_asof_methods_agree(spark, starts, facts):
    log = spark.createDataFrame([(k, at(d), f"{k}@{d}") for k, d in starts], "id int, ts timestamp_ntz, name string")
    dim = scd2_from_history(log, ["id"], "ts", ["name"])
    fact = spark.createDataFrame([(i, k, None if d is None else at(d)) for i, (k, d) in enumerate(facts)],
                                 "n int, key int, d timestamp_ntz")
    expected = []
    for i, (k, d) in enumerate(facts):
        before = [s for kk, s in starts if kk == k and d is not None and s <= d]
        expected.append((i, f"{k}@{max(before)}" if before else None))
    args = (fact, dim, ["key"], ["id"], "d", {"version": "name"})
    for options in ({"method": "range"}, {"method": "merge", "hot_key_rows": None},
                    {"method": "merge", "hot_key_rows": 1}, {}, {"method": "range", "disjoint": True}, {"method": "merge", "disjoint": True}):
        assert sorted(tuple(r) for r in scd2_asof_join(*args, **options).select("n", "version").collect()) == expected


def test_asof_respects_gaps_and_auto_switches(spark, monkeypatch):
    dim = spark.createDataFrame([(1, "old", at(0), at(2)), (1, "new", at(5), None)],
                                "id int, name string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    fact = spark.createDataFrame([(1, at(1)), (1, at(3)), (1, at(5)), (2, at(5))], "id int, d timestamp_ntz")
    for limit in (64, 1):
        monkeypatch.setattr("tristrata.operators.star.MAX_RANGE_VERSIONS", limit)
        joined = scd2_asof_join(fact, dim, ["id"], ["id"], "d", {"name": "name"})
        assert rows(joined, "id", F.dayofmonth("d"), "name") == [(1, 2, "old"), (1, 4, None), (1, 6, "new"), (2, 6, None)]
    with pytest.raises(ValueError, match="method"):
        scd2_asof_join(fact, dim, ["id"], ["id"], "d", {"name": "name"}, method="guess")


def test_current_join(spark):
    dim = spark.createDataFrame([(1, "old", False), (1, "new", True)], "id int, name string, is_current boolean")
    fact = spark.createDataFrame([(1,), (2,)], "key int")
    assert rows(scd2_current_join(fact, dim, ["key"], ["id"], {"name": "name"})) == [(1, "new"), (2, None)]


def test_table_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, None, "t"), (2, "b", "t"), (3, "c", "t"), (None, "n", "t")], SOURCE)
    new = spark.createDataFrame([(1, "a", "t"), (2, "b", "other"), (4, "d", "t"), (None, "n", "t")], SOURCE)
    assert rows(table_diff(old, new, ["id"]), "id", "change_type") == [(1, "changed"), (3, "removed"), (4, "added")]
    assert rows(table_diff(old, new, ["id"], include_unchanged=True), "id", "change_type")[0] == (None, "unchanged")
    assert rows(change_rate(old, new, ["id"])) == [(3, 1, 1, 1, 1 / 3)]


def test_dedup_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d"), (None, 1, "d")],
                               "k int, t int, v string")
    assert rows(dedup_latest(df, ["k"], ["t"])) == [(None, 1, "d"), (1, 2, "b")]
    assert dedup_latest(df, ["k"], ["t"]).columns == ["k", "t", "v"]
    assert rows(dedup_latest(df.select("k"), ["k"])) == [(None,), (1,)]


def test_both_as_of_methods_agree_on_odd_versions(spark):
    when = lambda d: None if d is None else datetime(2024, 1, d)
    versions = spark.createDataFrame(
        [(1, "a", when(1), when(9)), (1, "b", when(4), when(6)), (1, "c", None, when(5)), (1, "d", when(20), None), (1, "e", when(20), when(22)),
         (2, "f", None, None), (None, "g", when(1), None)], "k int, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    facts = spark.createDataFrame(
        [(i, k, when(d)) for i, (k, d) in enumerate([(1, d) for d in (None, 1, 3, 4, 5, 6, 8, 20, 23)] + [(2, 3), (None, 3), (3, 3)])],
        "id int, k int, at timestamp_ntz")
    found = [rows(scd2_asof_join(facts, versions, ["k"], ["k"], "at", {"v": "v"}, **options), "id", "v") for options in (
        {"method": "range"}, {"method": "merge"}, {"method": "merge", "hot_key_rows": None}, {"method": "merge", "hot_key_rows": 1})]
    values = [None, "a", "a", "b", "b", None, None, "d", "d", None, None, None]
    assert found[0] == sorted(enumerate(values), key=lambda r: str(r[0]))
    assert found[0] == found[1] == found[2] == found[3]


def test_a_key_first_seen_without_stamp_changes_later(spark):
    schema = "k int, v string, at timestamp_ntz"
    first = snapshot_timestamp(None, spark.createDataFrame([(1, "a", None)], schema), ["k"], "at", run_at="2024-01-01 00:00:00")
    assert rows(first, "v", "valid_from") == [("a", datetime(2024, 1, 1))]
    later = spark.createDataFrame([(1, "b", datetime(2024, 2, 1))], schema)
    versions = {r.v: r.valid_to for r in snapshot_timestamp(first, later, ["k"], "at").collect()}
    assert versions == {"a": datetime(2024, 2, 1), "b": None}
