import os
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.plans.specs import GoldSpec, Metric
from tristrata.operators import gold as gold_operators
from tristrata.operators.gold import build_gold
from tristrata.operators.scd import snapshot_check
from tristrata.session import new_work_path, staged, work_dir
from tristrata.sources import incremental, manifests, tables
from tristrata.sources.files import folder_names, path_exists
from tristrata.sources.incremental import (
    has_rows, incremental_filter, merge_months, month_folders, newest_date, read_fact, refresh_gold, upsert_incremental,
)
from tristrata.sources.readers import read_partitioned, read_sources
from tristrata.sources.tables import (
    advance_snapshot, layer_path, publish_view, read_open_versions, read_snapshot, read_table, table_exists, write_bucketed,
    write_profile, write_snapshot, write_table,
)
from tristrata.streaming.streams import read_file_stream, stream_fact, stream_gold, windowed_gold


def facts(spark, *values):
    return spark.createDataFrame(list(values), "sk string, d date, v int")


def month_files(spark, path, month):
    return sorted(os.listdir(month_folders(spark, path)[month]))


def stored(spark, path):
    return rows(read_fact(spark, path), "sk", F.col("d").cast("string"), "v")


def test_work_dir_is_the_configured_one(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_work_path(spark, "x") != new_work_path(spark, "x")


def test_read_sources_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "id int, month string")
    df.write.partitionBy("month").parquet(str(tmp_path / "pay"))
    whole = read_partitioned(spark, str(tmp_path / "pay"))
    assert whole.count() == 2
    assert "PartitionFilters: [isnotnull" in whole.filter("month = '2024-01'")._jdf.queryExecution().toString()
    children = [df.select("id"), df.withColumn("note", F.lit("n")).select("note", "id")]
    assert rows(read_partitioned(spark, children=children), "id", "note") == [
        (1, None), (1, "n"), (2, None), (2, "n")]
    with pytest.raises(ValueError, match="parent folder"):
        read_partitioned(spark)
    df.write.json(str(tmp_path / "j"))
    assert read_sources(spark, {"j": str(tmp_path / "j")}, "json")["j"].count() == 2
    publish_view(df, "public", "pay")
    assert read_sources(spark, {"v": "stg_public_pay"}, "table")["v"].count() == 2


def test_versions_are_committed_before_they_are_read(spark, tmp_path):
    path = layer_path(str(tmp_path), "gold", "agg")
    assert path.endswith("/gold/agg") and not table_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)
    write_table(spark.range(3), path)
    write_table(read_table(spark, path).filter("id > 0"), path)  # rebuilt from itself
    assert read_table(spark, path).count() == 2
    (tmp_path / "gold" / "agg" / "v000000003").mkdir()  # a job that did not finish
    assert read_table(spark, path).count() == 2
    write_table(spark.range(9), path)
    assert read_table(spark, path).count() == 9
    with pytest.raises(ValueError, match="layer"):
        layer_path("/x", "platinum", "t")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    a = write_bucketed(spark.range(1000).withColumn("x", F.lit(1)), "bucketed_a", 4, ["id"], str(tmp_path / "a"))
    b = write_bucketed(spark.range(1000).withColumn("y", F.lit(2)), "bucketed_b", 4, ["id"], str(tmp_path / "b"))
    joined = a.hint("merge").join(b, "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000


def test_write_profile(spark, tmp_path):
    write_profile(spark.range(2), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 2


def test_upsert_is_idempotent_and_moves_rows(spark, tmp_path):
    path = str(tmp_path / "fct")
    assert newest_date(spark, path, "d") is None
    first = facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 2, 5), 1), ("c", None, 1))
    upsert_incremental(first, path, "sk", "d")
    batch = facts(spark, ("a", date(2024, 3, 1), 2), ("c", None, 3), ("c", None, 2), ("n", date(2024, 2, 6), 2))
    expected = [("a", "2024-03-01", 2), ("b", "2024-02-05", 1), ("c", None, 3), ("n", "2024-02-06", 2)]
    for _ in range(2):
        upsert_incremental(batch, path, "sk", "d", order_by=("v",))
        assert stored(spark, path) == expected
    assert date(2024, 1, 1) not in month_folders(spark, path)
    assert newest_date(spark, path, "d") == date(2024, 3, 1)
    upsert_incremental(facts(spark), path, "sk", "d")
    assert stored(spark, path) == expected
    assert rows(read_fact(spark, path, since=date(2024, 3, 15)), "sk") == [("a",), ("c",)]
    upsert_incremental(facts(spark, ("c", date(2024, 2, 1), 4)), path, "sk", "d")  # the undated folder empties
    assert ("c", "2024-02-01", 4) in stored(spark, path) and len(stored(spark, path)) == 4


@pytest.mark.parametrize("step", ["write", "publish_text", "_remove_unnamed"])
def test_an_upsert_that_breaks_off_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "fct")
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 1, 6), 1), ("c", date(2024, 2, 5), 1)), path, "sk", "d")
    before = stored(spark, path)
    batch = facts(spark, ("a", date(2024, 2, 1), 2), ("n", None, 2))
    expected = [("a", "2024-02-01", 2), ("b", "2024-01-06", 1), ("c", "2024-02-05", 1), ("n", None, 2)]

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        if step == "write":
            broken.setattr(incremental, "folder_names", lambda s, p: lost() if "/runs/" in p else folder_names(s, p))
        else:
            broken.setattr(manifests if step == "publish_text" else incremental, step, lost)
        with pytest.raises(RuntimeError):
            upsert_incremental(batch, path, "sk", "d")
        broken.undo()
        assert stored(spark, path) == (expected if step == "_remove_unnamed" else before)
    upsert_incremental(batch, path, "sk", "d")
    assert stored(spark, path) == expected
    runs = {f.split("/runs/")[1].split("/")[0] for f in month_folders(spark, path).values()}
    assert runs <= set(os.listdir(tmp_path / "fct" / "runs")) and len(os.listdir(tmp_path / "fct" / "manifests")) <= 4


def test_untouched_months_are_not_rewritten(spark, tmp_path):
    path = str(tmp_path / "fct")
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 2, 5), 1)), path, "sk", "d")
    before = month_files(spark, path, date(2024, 1, 1))
    upsert_incremental(facts(spark, ("b", date(2024, 2, 9), 2)), path, "sk", "d", key_has_date=True)
    assert month_files(spark, path, date(2024, 1, 1)) == before
    assert stored(spark, path) == [("a", "2024-01-05", 1), ("b", "2024-02-09", 2)]


def opened(monkeypatch):
    """The months whose files an upsert reads, call by call."""
    calls, stored_months = [], incremental._stored

    def watched(spark, path, folders, schema=None):
        calls.append(set(folders))
        return stored_months(spark, path, folders, schema)

    monkeypatch.setattr(incremental, "_stored", watched)
    return calls


def test_an_upsert_opens_the_months_of_its_keys_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fct")
    monkeypatch.setattr(incremental, "KEYS_PER_BUCKET", 20)
    months = [date(2019 + i // 12, i % 12 + 1, 1) for i in range(60)]
    upsert_incremental(facts(spark, *((f"k{i}-{j}", m.replace(day=3 + j), i) for i, m in enumerate(months) for j in range(4))), path, "sk", "d")
    upsert_incremental(facts(spark, ("k0-0", date(2019, 1, 4), 100)), path, "sk", "d")  # makes the index
    assert len(folder_names(spark, f"{path}/keys/{incremental._newest(spark, path)[1]['keys']['runs'][0][0]}")) >= 12
    calls = opened(monkeypatch)
    touched = merge_months(facts(spark, ("k30-1", date(2020, 1, 9), 7), ("new", date(2020, 1, 9), 8), (None, date(2020, 1, 9), 9)), path, "sk", "d")
    assert set(touched) == {date(2020, 1, 1), months[30]} and calls == [{date(2020, 1, 1), months[30]}]
    monkeypatch.undo()
    found = {sk: (d, v) for sk, d, v in stored(spark, path)}
    assert len(found) == 242 and found["k30-1"] == ("2020-01-09", 7) and found[None] == ("2020-01-09", 9)
    merge_months(facts(spark, ("k30-1", date(2021, 1, 9), 7)), path, "sk", "d")  # where the last run put it
    assert months[30] not in merge_months(facts(spark, ("k30-1", None, 7)), path, "sk", "d")
    assert [r for r in stored(spark, path) if r[0] == "k30-1"] == [("k30-1", None, 7)]


def test_index_runs_stay_few_and_equal_a_rebuild(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fct")
    rng, expected = __import__("random").Random(3), {}
    for i in range(14):
        batch = {f"k{rng.randrange(40)}": (rng.choice([None, date(2024, rng.randint(1, 6), 2)]), i) for _ in range(rng.choice([1, 2, 12]))}
        upsert_incremental(facts(spark, *((k, d, v) for k, (d, v) in batch.items())), path, "sk", "d")
        expected |= batch
        assert stored(spark, path) == sorted(((k, d and str(d), v) for k, (d, v) in expected.items()), key=lambda r: [(v is not None, str(v)) for v in r])
    assert len(incremental._newest(spark, path)[1]["keys"]["runs"]) <= 4
    merge_months(facts(spark, ("n", date(2024, 1, 5), 99)), path, "sk", "d", key_has_date=True)  # goes on without index
    assert "keys" not in incremental._newest(spark, path)[1]
    names = {r for f in incremental._named_folders(incremental._newest(spark, path)[1]) for r in f.split("/")[1:2]}
    assert incremental.remove_strays(spark, path, -1) and names <= set(os.listdir(tmp_path / "fct" / "runs"))
    assert len(stored(spark, path)) == len(expected) + 1


@pytest.mark.parametrize("other, repeats", [
    (("x", date(2024, 5, 1), 9), False), (("b", date(2024, 2, 7), 9), True), (("a", date(2024, 5, 1), 9), True)])
def test_two_writers(spark, tmp_path, monkeypatch, other, repeats):
    """Another upsert is published while one is on its way: in another month, in the same, or with the same key elsewhere."""
    path = str(tmp_path / "fct")
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 2, 5), 1)), path, "sk", "d")
    upsert_incremental(facts(spark, ("c", date(2024, 3, 5), 1)), path, "sk", "d")
    publish, written = manifests.publish, []

    def late(spark_, path_, number, content):
        if not written:
            written.append(True)
            upsert_incremental(facts(spark, other), path, "sk", "d")
        publish(spark_, path_, number, content)

    monkeypatch.setattr(manifests, "publish", late)
    merges, write_months = [], incremental._write_months
    monkeypatch.setattr(incremental, "_write_months", lambda rows, p: merges.append(1) or write_months(rows, p))
    upsert_incremental(facts(spark, ("a", date(2024, 2, 8), 2)), path, "sk", "d")
    expected = {"a": ("2024-02-08", 2), "b": ("2024-02-05", 1), "c": ("2024-03-05", 1)}
    expected |= {other[0]: (str(other[1]), other[2])} if other[0] != "a" else {}
    assert {sk: (d, v) for sk, d, v in stored(spark, path)} == expected and len(stored(spark, path)) == len(expected)
    assert len(merges) == (3 if repeats else 2)
    upsert_incremental(facts(spark, ("x", None, 1), ("b", None, 1)), path, "sk", "d")  # the index knows both
    assert len(stored(spark, path)) == len({*expected, "x"})


def test_a_manifest_number_is_published_once(spark, tmp_path):
    manifests.publish(spark, str(tmp_path), 1, {"months": {}})
    with pytest.raises(FileExistsError):
        manifests.publish(spark, str(tmp_path), 1, {"months": {"other": "run"}})
    assert manifests.newest(spark, str(tmp_path)) == (1, {"months": {}}) and len(os.listdir(tmp_path / "manifests")) <= 3


def test_lookback(spark):
    df = facts(spark, ("old", date(2024, 1, 1), 1), ("edge", date(2024, 1, 3), 1), ("in", date(2024, 1, 4), 1),
               ("undated", None, 1))
    assert rows(incremental_filter(df, "d", date(2024, 1, 10)), "sk") == [("in",), ("undated",)]
    assert rows(incremental_filter(df, "d", date(2024, 1, 10), 8), "sk") == [("edge",), ("in",), ("undated",)]
    assert incremental_filter(df, "d", None).count() == 4


def test_incremental_filter_reaches_the_scan(spark, tmp_path):
    facts(spark, ("a", date(2024, 1, 1), 1)).write.parquet(str(tmp_path / "p"))
    plan = incremental_filter(spark.read.parquet(str(tmp_path / "p")), "d", date(2024, 1, 10))
    assert "PushedFilters: [Or(GreaterThan(d,2024-01-03),IsNull(d))]" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("grain", ["daily", "weekly", "monthly", "yearly"])
def test_refreshed_aggregate_equals_full_rebuild(spark, tmp_path, grain):
    fact, gold = str(tmp_path / "fct"), str(tmp_path / "gold")
    spec = GoldSpec("agg", "fct", grain, (), (Metric("n", "COUNT"), Metric("v", "SUM", "v")))

    def day(m, d):
        return date(2024, m, d)

    upsert_incremental(facts(spark, ("a", day(1, 5), 1), ("b", day(1, 31), 1), ("c", day(2, 1), 1), ("d", day(4, 9), 1),
                             ("e", date(2023, 12, 31), 1), ("u", None, 1)), fact, "sk", "d")
    refresh_gold(spark, fact, gold, spec, "d")
    for batch in ([("b", day(1, 30), 5), ("f", day(2, 2), 7)], [("d", day(3, 31), 2)], [("u", day(1, 1), 3)],
                  [("e", None, 4)], []):
        months = merge_months(facts(spark, *batch), fact, "sk", "d")
        got = refresh_gold(spark, fact, gold, spec, "d", months=months)
        assert rows(got) == rows(build_gold(read_fact(spark, fact), spec, fact_date="d"))


def test_refresh_leaves_other_months_alone(spark, tmp_path):
    fact, gold = str(tmp_path / "fct"), str(tmp_path / "gold")
    spec = GoldSpec("agg", "fct", "monthly", (), (Metric("n", "COUNT"),))
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 2, 5), 1)), fact, "sk", "d")
    refresh_gold(spark, fact, gold, spec, "d")
    untouched = month_files(spark, gold, date(2024, 1, 1))
    months = merge_months(facts(spark, ("c", date(2024, 2, 9), 1)), fact, "sk", "d")
    assert months == [date(2024, 2, 1)]
    assert rows(refresh_gold(spark, fact, gold, spec, "d", months=months)) == [(date(2024, 1, 1), 1), (date(2024, 2, 1), 2)]
    assert month_files(spark, gold, date(2024, 1, 1)) == untouched


def test_yearly_refresh_reads_the_changed_month_of_the_fact(spark, tmp_path, monkeypatch):
    fact, gold = str(tmp_path / "fct"), str(tmp_path / "agg")
    schema = "sk string, d date, v int, price decimal(10,2), k string"
    spec = GoldSpec("agg", "fct", "yearly", ("k",), (
        Metric("n", "COUNT"), Metric("s", "SUM", "price"), Metric("a", "AVG", "price"), Metric("m", "MIN", "v"), Metric("x", "MAX", "v"),
        Metric("u", "COUNT_DISTINCT", "v"), Metric("c", "COUNT", "v")))
    made = [(f"{y}-{m}-{i}", date(y, m, 1 + i), None if i == 2 else (m * i) % 5, Decimal(m * i + 1) / 4, "ab"[i % 2]) for y in (2023, 2024) for m in range(1, 13) for i in range(4)]
    upsert_incremental(spark.createDataFrame([*made, ("null", None, 7, Decimal(1), "a")], schema), fact, "sk", "d")
    refresh_gold(spark, fact, gold, spec, "d", ("v",))
    batch = spark.createDataFrame([("2024-5-1", date(2024, 5, 9), 50, Decimal(9), "b"), ("null", None, 8, Decimal(2), "b")], schema)
    months = merge_months(batch, fact, "sk", "d")
    read = []
    monkeypatch.setattr(incremental, "partial_states", lambda rows, *args: read.append(rows) or gold_operators.partial_states(rows, *args))
    found = refresh_gold(spark, fact, gold, spec, "d", ("v",), months=months)
    assert rows(found) == rows(build_gold(read_fact(spark, fact), replace(spec, date="d"), ("v",)).select(found.columns))
    assert {r[0] for r in read[0].select(F.trunc("d", "month")).distinct().collect()} == {date(2024, 5, 1), None}
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-05-01" in plan
    assert rows(refresh_gold(spark, fact, gold, spec, "d", ("v",), months=[])) == rows(found)


def test_stored_snapshot_keeps_history_without_rewriting(spark, tmp_path):
    path, schema = str(tmp_path / "snap"), "id int, name string"
    for day, values in ((1, [(1, "a"), (2, "x")]), (2, [(1, "b"), (2, "x")]), (3, [(1, "a"), (2, "x"), (3, "n")])):
        write_snapshot(snapshot_check(read_open_versions(spark, path), spark.createDataFrame(values, schema), ["id"], datetime(2024, 1, day)), path)
    assert rows(read_snapshot(spark, path), "id", "name", F.dayofmonth("valid_from"), F.dayofmonth("valid_to")) == [
        (1, "a", 1, 2), (1, "a", 3, None), (1, "b", 2, 3), (2, "x", 1, None), (3, "n", 3, None)]
    assert read_open_versions(spark, path).count() == 3


def snapshot_run(spark, path, day, values, schema="id int, name string"):
    source = spark.createDataFrame(values, schema)
    advance_snapshot(spark, path, lambda previous: snapshot_check(previous, source, ["id"], f"2024-01-{day:02d} 00:00:00"))


def test_many_runs_of_a_snapshot_leave_few_folders(spark, tmp_path):
    path = str(tmp_path / "snap")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for day in range(1, 24):
        snapshot_run(spark, path, day, [(1, f"v{day}"), (2, "x")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    content = manifests.newest(spark, path)[1]
    assert len(content["closed"]) <= 4 and sum(n for _, n in content["closed"]) == 22
    assert all(a[1] > 4 * b[1] for a, b in zip(content["closed"], content["closed"][1:]))
    named = {f.split("/")[1] for f in tables._snapshot_folders(content)}
    holding = {run for run in os.listdir(tmp_path / "snap" / "runs") if any(n.startswith("state=") for n in os.listdir(tmp_path / "snap" / "runs" / run))}
    assert named <= holding and len(holding) <= len(named) + 4  # those of the manifest before are still there
    history = rows(read_snapshot(spark, path), "id", "name", F.dayofmonth("valid_from"), F.dayofmonth("valid_to"))
    assert history == sorted([(1, f"v{d}", d, d + 1 if d < 23 else None) for d in range(1, 24)] + [(2, "x", 1, None)],
                             key=lambda r: [(v is not None, str(v)) for v in r])


def test_an_interrupted_merge_of_closed_versions_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    for day in (1, 2, 3):
        with monkeypatch.context() as broken:
            broken.setattr(tables, "compact_snapshot", lambda *_: None)
            snapshot_run(spark, path, day, [(1, f"v{day}")])
    before, history = manifests.newest(spark, path), rows(read_snapshot(spark, path))

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(manifests, "publish_text", lost)
        with pytest.raises(RuntimeError):
            tables.compact_snapshot(spark, path)
    assert manifests.newest(spark, path) == before and rows(read_snapshot(spark, path)) == history
    tables.compact_snapshot(spark, path)
    assert len(manifests.newest(spark, path)[1]["closed"]) == 1 and rows(read_snapshot(spark, path)) == history


def test_a_snapshot_run_is_repeated_on_top_of_another(spark, tmp_path, monkeypatch):
    path, publish, others = str(tmp_path / "snap"), manifests.publish, [True]
    snapshot_run(spark, path, 1, [(1, "a")])

    def late(spark_, path_, number, content):
        if others and others.pop():
            snapshot_run(spark, path, 2, [(1, "b")])
        publish(spark_, path_, number, content)

    monkeypatch.setattr(manifests, "publish", late)
    snapshot_run(spark, path, 3, [(1, "c")])
    assert rows(read_snapshot(spark, path), "name", F.dayofmonth("valid_from"), F.dayofmonth("valid_to")) == [("a", 1, 2), ("b", 2, 3), ("c", 3, None)]


def test_snapshot_columns_come_go_and_widen(spark, tmp_path):
    path = str(tmp_path / "snap")
    snapshot_run(spark, path, 1, [(1, 5, "gone"), (2, 6, None)], "id int, n int, note string")
    snapshot_run(spark, path, 2, [(1, 5, "new"), (2, 1 << 40, None), (3, 7, None)], "id int, n bigint, extra string")
    snapshot_run(spark, path, 3, [(1, 5, "new"), (2, 1 << 40, None), (3, 7, None)], "id int, n bigint, extra string")
    assert rows(read_snapshot(spark, path), "id", "n", "extra", "note", F.dayofmonth("valid_from"), F.dayofmonth("valid_to")) == [
        (1, 5, None, "gone", 1, 2), (1, 5, "new", None, 2, None), (2, 1 << 40, None, None, 2, None), (2, 6, None, None, 1, 2), (3, 7, None, None, 2, None)]
    with pytest.raises(ValueError, match="text"):
        snapshot_run(spark, path, 4, [("1", 5)], "id string, n bigint")


def test_fact_columns_come_go_and_widen(spark, tmp_path):
    path = str(tmp_path / "fct")
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1), ("b", date(2024, 2, 5), 1)), path, "sk", "d")
    wide = spark.createDataFrame([("b", date(2024, 2, 6), 1 << 40, "x")], "sk string, d date, v bigint, extra string")
    upsert_incremental(wide, path, "sk", "d")
    upsert_incremental(spark.createDataFrame([("c", date(2024, 2, 7))], "sk string, d date"), path, "sk", "d")
    assert rows(read_fact(spark, path), "sk", F.col("d").cast("string"), "v", "extra") == [
        ("a", "2024-01-05", 1, None), ("b", "2024-02-06", 1 << 40, "x"), ("c", "2024-02-07", None, None)]
    assert read_fact(spark, path, since=date(2025, 1, 1)).columns == read_fact(spark, path).columns == ["sk", "d", "v", "extra"]


def test_staged_files_go_only_after_success(spark):
    with staged(spark.range(3), "x") as kept:
        folder = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert kept.count() == 3
    assert not path_exists(spark, folder)
    with pytest.raises(RuntimeError):
        with staged(spark.range(3), "x") as kept:
            folder = kept.inputFiles()[0].rsplit("/", 1)[0]
            raise RuntimeError
    assert path_exists(spark, folder)


def test_filter_on_zoneless_timestamps_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz").write.parquet(path)
    plan = incremental_filter(spark.read.parquet(path), "t", datetime(2024, 1, 10))
    assert "PushedFilters: [Or(GreaterThan(t,2024-01-03T00:00),IsNull(t))]" in plan._jdf.queryExecution().toString()


def test_empty_tables(spark, tmp_path):
    path, snap = str(tmp_path / "fct"), str(tmp_path / "snap")
    nothing = facts(spark)
    assert upsert_incremental(nothing, path, "sk", "d").columns == nothing.columns
    assert newest_date(spark, path, "d") is None and not has_rows(spark, path)
    upsert_incremental(facts(spark, ("a", date(2024, 1, 5), 1)), path, "sk", "d")
    assert stored(spark, path) == [("a", "2024-01-05", 1)]
    empty = snapshot_check(None, spark.createDataFrame([], "id int, name string"), ["id"], datetime(2024, 1, 1))
    write_snapshot(empty, snap)
    assert read_open_versions(spark, snap) is None and read_snapshot(spark, snap, otherwise=empty).count() == 0


def test_undated_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_incremental(facts(spark, ("a", None, 1), ("b", None, 1)), path, "sk")
    upsert_incremental(facts(spark, ("b", None, 2), ("c", None, 2)), path, "sk")
    assert rows(read_table(spark, path), "sk", "v") == [("a", 1), ("b", 2), ("c", 2)]


SCHEMA = "event_id int, kind string, ts timestamp_ntz, value int"


def add_file(spark, folder, *values):
    spark.createDataFrame(list(values), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_stream_fact_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "fct", "cp"))
    add_file(spark, folder, (1, "a", datetime(2024, 1, 1), 1), (2, "a", datetime(2024, 1, 2), 1))

    def run():
        stream = read_file_stream(spark, folder, SCHEMA, files_per_batch=1)
        stream_fact(stream, lambda batch: batch, path, "event_id", "ts", checkpoint).awaitTermination()
        return rows(read_fact(spark, path), "event_id", "value")

    assert run() == [(1, 1), (2, 1)]
    add_file(spark, folder, (2, "a", datetime(2024, 1, 2), 5), (3, "b", datetime(2024, 2, 1), 1))
    assert run() == [(1, 1), (2, 5), (3, 1)]
    assert run() == [(1, 1), (2, 5), (3, 1)]


def test_stream_gold_drops_rows_later_than_the_lookback(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "gold", "cp"))
    spec = GoldSpec("agg", "events", "weekly", ("kind",), (Metric("n", "COUNT"), Metric("s", "SUM", "value")), "ts")

    def run():
        stream = read_file_stream(spark, folder, SCHEMA, files_per_batch=1)
        stream_gold(stream, spec, path, checkpoint, lateness_days=7).awaitTermination()
        return rows(read_fact(spark, path), F.col("weekly_date").cast("string"), "kind", "n", "s")

    add_file(spark, folder, (1, "a", datetime(2024, 1, 7, 23), 1), (2, "a", datetime(2024, 1, 8), 2))
    assert run() == [("2024-01-01", "a", 1, 1), ("2024-01-08", "a", 1, 2)]
    add_file(spark, folder, (3, "a", datetime(2024, 1, 31), 3), (4, "b", datetime(2024, 1, 8), 4))
    assert len(run()) == 4
    add_file(spark, folder, (5, "a", datetime(2024, 1, 8), 100), (6, "a", datetime(2024, 1, 30), 6))
    assert run() == [("2024-01-01", "a", 1, 1), ("2024-01-08", "a", 1, 2), ("2024-01-08", "b", 1, 4),
                     ("2024-01-29", "a", 2, 9)]


def test_stream_gold_equals_the_batch_aggregate(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "gold", "cp"))
    spec = GoldSpec("agg", "events", "monthly", ("kind",), (Metric("n", "COUNT"), Metric("s", "SUM", "value")), "ts")
    files = [((1, "a", datetime(2024, 1, 7), 1), (2, "a", None, 2)), ((3, "a", datetime(2024, 5, 1), 3), (4, None, None, 4)),
             ((5, "a", datetime(2024, 1, 1), 5), (6, "a", None, 6))]
    for file in files:
        add_file(spark, folder, *file)
        stream = read_file_stream(spark, folder, SCHEMA, files_per_batch=1)
        stream_gold(stream, spec, path, checkpoint).awaitTermination()
        got = read_fact(spark, path).drop("agg_sk")
        assert rows(got) == rows(build_gold(spark.read.parquet(folder), spec).select(got.columns))


def test_stream_counts_distinct_values_exactly(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "gold", "cp"))
    spec = GoldSpec("agg", "events", "monthly", ("kind",), (
        Metric("n", "COUNT"), Metric("k", "COUNT", "kind"), Metric("u", "COUNT_DISTINCT", "value"), Metric("e", "COUNT_DISTINCT", "event_id"), Metric("s", "SUM", "value")), "ts")
    for file in [((1, "a", datetime(2024, 1, 7), 1), (2, "a", None, 2)), ((3, "a", datetime(2024, 1, 1), 1), (4, None, None, None)),
                 ((5, "a", datetime(2024, 1, 1), 5), (1, "a", datetime(2024, 1, 9), None))]:
        add_file(spark, folder, *file)
        stream = read_file_stream(spark, folder, SCHEMA, files_per_batch=1)
        stream_gold(stream, spec, path, checkpoint).awaitTermination()
        got = read_fact(spark, path).drop("agg_sk")
        assert rows(got) == rows(build_gold(spark.read.parquet(folder), spec).select(got.columns))
    exact = GoldSpec("agg", "e", "daily", (), (Metric("n", "COUNT_DISTINCT", "kind"),), "ts")
    with pytest.raises(ValueError, match="approx"):
        stream_gold(stream, exact, path, checkpoint, lateness_days=7)


def test_stream_grains(spark, tmp_path):
    add_file(spark, str(tmp_path / "in"), (1, "a", datetime(2024, 1, 7), 1))
    stream = read_file_stream(spark, str(tmp_path / "in"), SCHEMA)
    with pytest.raises(ValueError, match="by day or week"):
        windowed_gold(stream, GoldSpec("agg", "e", "monthly", (), (Metric("n", "COUNT"),), "ts"))
    assert windowed_gold(stream, GoldSpec("agg", "e", "daily", (), (Metric("n", "COUNT"),), "ts")).isStreaming
