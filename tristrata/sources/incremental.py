"""Incremental tables: lookback filter, upsert by surrogate key, refresh of the aggregates above.

A dated table is a set of months. Every run writes the months that it changes, once, into a folder of its own
(``runs/run=<id>/load_month=<first of month>``) and then publishes a manifest (``manifests/<n>.json``) that says which
run's folder holds each month. Readers follow the newest manifest, so they see a run as a whole or not at all, and a run
that breaks off leaves the table as it was; repeating it gives what it would have given.

Beside the months lies an index of keys (``keys/run=<id>/bucket=<n>``): the month of each key by a 64-bit hash, in buckets
of hashes. An upsert looks up the buckets of its keys and opens the months it finds, not the key column of the table. Each
run adds the entries of its batch; the entries of later runs count before earlier ones. Runs of like size are merged, so
there are never more than the logarithm of the table's size by that of a batch. Two keys of one hash open a month too many,
which is written again as it was.

Several writers may work on a table. A run whose months nobody else has changed meanwhile, and whose keys did not turn up
in months that others changed, is added to what they published; otherwise it is repeated on top of theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Sequence
from dataclasses import replace
from datetime import date as Date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tristrata.functions.columns import common_schema, fitted
from tristrata.functions.scalars import grain_unit, to_grain
from tristrata.operators.dedup import dedup_latest
from tristrata.operators.gold import build_gold, merge_states, partial_states, resolve_gold
from tristrata.plans.specs import GoldSpec
from tristrata.session import staged
from tristrata.sources import manifests
from tristrata.sources.files import folder_names
from tristrata.sources.tables import read_table, table_exists, write_table

MONTH = "load_month"
# How folders name the month of undated rows.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
DEFAULT_LOOKBACK_DAYS = 7
# Keys of one bucket of the index, buckets at most, and how much larger than what follows a run must be to stay unmerged.
KEYS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
MERGE_FACTOR = 4


def incremental_filter(
    df: DataFrame, date: str | Column, newest, lookback_days: int = DEFAULT_LOOKBACK_DAYS
) -> DataFrame:
    """Rows dated after ``newest - lookback_days``, and undated rows; everything when ``newest`` is None.

    ``newest`` is a literal of the column's type, so the comparison reaches the Parquet scan.
    """
    if newest is None:
        return df
    column = F.col(date) if isinstance(date, str) else date
    bound = F.lit(newest - timedelta(days=lookback_days)).cast(df.select(column).schema[0].dataType)
    return df.filter((column > bound) | column.isNull())


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: ``months`` with their runs, and the index of ``keys`` if there is one."""
    number, content = manifests.newest(spark, path)
    return number, content if "months" in content or not content else {"months": content}


def _folders(path: str, months: dict[str, str]) -> dict[Date | None, str]:
    return {None if m == NO_MONTH else Date.fromisoformat(m): f"{path}/runs/{run}/{MONTH}={m}" for m, run in months.items()}


def _schema(content: dict) -> T.StructType | None:
    """The columns of a table without its month; None where a manifest does not say."""
    return T.StructType.fromJson(content["schema"]) if "schema" in content else None


def month_folders(spark: SparkSession, path: str) -> dict[Date | None, str]:
    """The folder of each month of the table, by its newest manifest."""
    return _folders(path, _newest(spark, path)[1].get("months", {}))


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a dated table holds anything yet."""
    return bool(month_folders(spark, path))


def read_fact(
    spark: SparkSession, path: str, since: Date | None = None, otherwise: DataFrame | None = None
) -> DataFrame:
    """A dated table as it is now; ``since`` prunes months before any file is listed.

    Months written before a column came, or a type grew, are read with NULL there, or in the wider type. An empty table
    has no file that says which columns it has: ``otherwise`` gives them.
    """
    content = _newest(spark, path)[1]
    folders, schema = _folders(path, content.get("months", {})), _schema(content)
    if otherwise is not None and not folders:
        return otherwise.limit(0)
    if schema is None and otherwise is not None:
        schema = otherwise.schema
    if since is not None:
        recent = {m: f for m, f in folders.items() if m is None or m >= since.replace(day=1)}
        if not recent:
            return _stored(spark, path, folders, schema).limit(0).drop(MONTH)
        folders = recent
    return _stored(spark, path, folders, schema).drop(MONTH)


def newest_date(spark: SparkSession, path: str, date: str):
    """Greatest date stored, or None; reads the date column of the newest month only."""
    content = _newest(spark, path)[1]
    folders = _folders(path, content.get("months", {}))
    dated = [m for m in folders if m is not None]
    if not dated:
        return None
    return _stored(spark, path, {max(dated): folders[max(dated)]}, _schema(content)).agg(F.max(date)).first()[0]


def _stored(spark: SparkSession, path: str, folders: dict[Date | None, str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of these months with their month; a known ``schema`` saves the job that infers it."""
    if not folders:
        raise FileNotFoundError(f"no table in months at {path}")
    reader = spark.read.option("basePath", f"{path}/runs").option("mergeSchema", "true")
    if schema is not None:
        own = [f for f in schema if f.name != MONTH]
        reader = reader.schema(T.StructType([*own, T.StructField("run", T.StringType()), T.StructField(MONTH, T.DateType())]))
    return reader.parquet(*folders.values()).drop("run").withColumn(MONTH, F.col(MONTH).cast("date"))


def in_months(column: str | Column, months: Collection[Date | None]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    known = [m for m in months if m is not None]
    inside = column.isin(known) if known else F.lit(False)
    return inside | column.isNull() if None in months else inside


def upsert_incremental(
    batch: DataFrame, path: str, key: str, date: str | None = None,
    order_by: tuple[str, ...] = (), key_has_date: bool = False, unique: bool = False,
) -> DataFrame:
    """Store ``batch`` into the table at ``path``: rows with a known key replace the old row, others are added.

    The batch is first reduced to one row per key, the greatest by ``order_by``, unless ``unique`` promises
    that it is. Without ``date`` the table is rewritten as a new version; with it see ``merge_months``.
    """
    spark = batch.sparkSession
    if date is not None:
        merge_months(batch, path, key, date, order_by, key_has_date, unique)
        return read_fact(spark, path, otherwise=batch)
    if not unique:
        batch = dedup_latest(batch, [key], order_by)
    if table_exists(spark, path):
        old = read_table(spark, path)
        batch = old.join(batch.select(key), key, "left_anti").unionByName(batch)
    return write_table(batch, path)


def merge_months(
    batch: DataFrame, path: str, key: str, date: str, order_by: tuple[str, ...] = (), key_has_date: bool = False,
    unique: bool = False,
) -> list[Date | None] | None:
    """Upsert into a dated table and return the months rewritten (None inside for undated rows, None alone for
    a first load, which writes everything).

    Rewritten are the months of the batch and those where its keys were stored before, by the index of keys. The first
    upsert into a table reads its key column once to make the index; ``key_has_date`` does without one, for a key that is
    derived from the date and cannot change month. A batch may have new columns, lack some or have wider types.
    """
    spark = batch.sparkSession
    fresh = (batch if unique else dedup_latest(batch, [key], order_by)).withColumn(MONTH, to_grain(date, "month"))
    if not _newest(spark, path)[1]:
        try:
            _publish(fresh, path)
            return None
        except FileExistsError:  # another writer was first: what follows merges
            pass
    with staged(fresh, "batch") as fresh:
        keys, own = fresh.select(key), [row[0] for row in fresh.select(MONTH).distinct().collect()]
        while own:
            number, state = _newest(spark, path)
            schema = _with_schema(spark, state, fresh)
            folders, touched, index, merged = _folders(path, state["months"]), list(own), None, fitted(fresh, schema)
            if not key_has_date:
                index = state.get("keys") or (_index_of(spark, path, folders, key, merged) if folders else {"buckets": 1, "runs": []})
                touched += [m for m in _months_of(spark, path, index, keys, key) if m not in own]
            before = {m: folders[m] for m in touched if m in folders}
            if before:
                kept = _stored(spark, path, before, schema).join(keys, key, "left_anti")
                merged = kept.select(*merged.columns).unionByName(merged)
            run, filled = _write_months(merged, path)
            if index is not None:
                index = _with_entries(spark, path, index, fresh, key)
            if _commit(spark, path, number, state, touched, run, filled, index, fresh, None if key_has_date else key):
                return touched
    return []


def _commit(
    spark: SparkSession, path: str, number: int, base: dict, touched: Collection[Date | None], run: str, filled: Collection[str],
    index: dict | None, fresh: DataFrame, key: str | None,
) -> bool:
    """Publish a run that was made from manifest ``number`` (``base``); False if another run came in its way."""
    gone = {NO_MONTH if m is None else m.isoformat() for m in touched}
    while True:
        at, now = _newest(spark, path)
        changed = {m for m in {*now["months"], *base["months"]} if now["months"].get(m) != base["months"].get(m)}
        if changed & gone:
            return False
        others = _folders(path, {m: now["months"][m] for m in changed if m in now["months"]})
        if key is not None and others:
            if not _stored(spark, path, others, fresh.schema).select(key).join(fresh.select(key), key, "left_semi").isEmpty():
                return False
        content = {"months": {m: r for m, r in now["months"].items() if m not in gone} | dict.fromkeys(filled, run),
                   "schema": _without_month(_with_schema(spark, now, fresh)).jsonValue()}
        if index is not None and now.get("keys") == base.get("keys"):
            content["keys"] = index
        elif index is not None and now.get("keys"):
            content["keys"] = _with_entries(spark, path, now["keys"], fresh, key, merge=False)
        try:
            manifests.publish(spark, path, at + 1, content)
        except FileExistsError:
            continue
        _remove_unnamed(spark, path)
        return True


def _without_month(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != MONTH])


def _with_schema(spark: SparkSession, content: dict, rows: DataFrame) -> T.StructType:
    """The columns of ``rows``, widened by those the table has."""
    known = _schema(content)
    return rows.schema if known is None else common_schema(spark, rows.schema, known)


def _entries(rows: DataFrame, key: str) -> DataFrame:
    """``(h, load_month)`` of rows with a key; rows without one are never replaced."""
    return rows.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), MONTH)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("h"), F.lit(buckets)).cast("int").alias("bucket")


def _fitting_buckets(keys: int) -> int:
    return min(MAX_BUCKETS, max(1, -(-keys // KEYS_PER_BUCKET)))


def _write_entries(entries: DataFrame, path: str, buckets: int) -> str:
    run = f"run={uuid.uuid4().hex}"
    dealt = entries.select("h", MONTH, _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "h")
    dealt.write.partitionBy("bucket").parquet(f"{path}/keys/{run}")
    return run


def _read_entries(spark: SparkSession, path: str, runs: Sequence[tuple[str, int]], wanted: Collection[int] | None = None) -> DataFrame:
    """``(h, load_month, age)`` of these runs of the index, the oldest of age 0; of the ``wanted`` buckets only."""
    found = spark.createDataFrame([], f"h long, {MONTH} date, age int")
    for age, (run, _) in enumerate(runs):
        names = [n for n in folder_names(spark, f"{path}/keys/{run}") if n.startswith("bucket=")]
        names = [n for n in names if wanted is None or int(n.removeprefix("bucket=")) in wanted]
        if names:
            entries = spark.read.schema(f"h long, {MONTH} date").parquet(*(f"{path}/keys/{run}/{n}" for n in names))
            found = found.unionByName(entries.withColumn("age", F.lit(age)))
    return found


def _latest(entries: DataFrame) -> DataFrame:
    return entries.groupBy("h").agg(F.max_by(MONTH, "age").alias(MONTH))


def _index_of(spark: SparkSession, path: str, folders: dict[Date | None, str], key: str, like: DataFrame) -> dict:
    """A new index of the whole table."""
    stored = _stored(spark, path, folders, like.schema)
    rows = stored.count()
    buckets = _fitting_buckets(rows)
    return {"buckets": buckets, "runs": [[_write_entries(_entries(stored, key), path, buckets), rows]]}


def _months_of(spark: SparkSession, path: str, index: dict, keys: DataFrame, key: str) -> list[Date | None]:
    """The months that hold ``keys``; buckets and months are short lists."""
    hashes = keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    wanted = {row[0] for row in hashes.select(_bucket(index["buckets"])).distinct().collect()}
    entries = _read_entries(spark, path, index["runs"], wanted).join(hashes, "h", "left_semi")
    return [row[0] for row in _latest(entries).select(MONTH).distinct().collect()]


def _with_entries(spark: SparkSession, path: str, index: dict, fresh: DataFrame, key: str, merge: bool = True) -> dict:
    """The index with a run for ``fresh``, into which the runs before are merged as long as they are not much larger."""
    added, runs = _entries(fresh, key), list(index["runs"])
    rows, first = added.count(), len(runs)
    while merge and first and runs[first - 1][1] <= MERGE_FACTOR * rows:
        first -= 1
        rows += runs[first][1]
    buckets = index["buckets"] if first else _fitting_buckets(rows)
    if first < len(runs):
        added = _latest(_read_entries(spark, path, runs[first:]).unionByName(added.withColumn("age", F.lit(len(runs)))))
    return {"buckets": buckets, "runs": [*runs[:first], [_write_entries(added, path, buckets), rows]]}


def refresh_gold(
    spark: SparkSession, fact_path: str, path: str, spec: GoldSpec, date: str, measures: Collection[str] = (),
    months: list[Date | None] | None = None,
) -> DataFrame:
    """Rebuild the aggregate at ``path`` for the fact's ``months`` only; for all of them when None.

    The aggregate lies in month folders of its period's first day. Periods that reach into a rewritten month
    are computed anew from the fact's folders that feed them; all others stay as they are. Aggregates by year are merged
    from states by month that lie beside them (``<path>/state``), so that only the rewritten months of the fact are read.
    """
    spec = replace(spec, date=date)
    content = _newest(spark, fact_path)[1]
    fact = _stored(spark, fact_path, _folders(fact_path, content.get("months", {})), _schema(content))
    grain = resolve_gold(fact, spec, measures).grain
    period = f"{grain}_date"
    if grain_unit(grain) == "year":
        return _refresh_by_states(spark, fact, path, replace(spec, grain=grain), measures, months)
    if months is None or not has_rows(spark, path):
        gold = build_gold(fact.drop(MONTH), spec, measures)
        _publish(gold.withColumn(MONTH, to_grain(period, "month")), path)
        return read_fact(spark, path, otherwise=gold)
    periods = {m for month in months for m in _period_months(month, grain)}
    feeding = fact.filter(in_months(MONTH, {m for p in periods for m in _feeding_months(p, grain)}))
    feeding = feeding.filter(in_months(to_grain(to_grain(date, grain), "month"), periods)).drop(MONTH)
    if periods:
        gold = build_gold(feeding, spec, measures).withColumn(MONTH, to_grain(period, "month"))
        _publish(gold, path, list(periods))
    return read_fact(spark, path, otherwise=build_gold(fact.drop(MONTH), spec, measures))


def _refresh_by_states(spark: SparkSession, fact: DataFrame, path: str, spec: GoldSpec, measures: Collection[str],
                       months: list[Date | None] | None) -> DataFrame:
    state, period = f"{path}/state", f"{spec.grain}_date"
    whole = build_gold(fact.drop(MONTH), spec, measures)
    if months is None or not has_rows(spark, path) or not has_rows(spark, state):
        months = periods = None
    else:
        fact = fact.filter(in_months(MONTH, months))
        periods = list({m for month in months for m in _period_months(month, spec.grain)})
    if months != []:
        states = partial_states(fact.drop(MONTH), spec, measures)
        _publish(states.withColumn(MONTH, F.col("__period")), state, months)
        feeding = read_fact(spark, state, otherwise=states)
        if periods is not None:
            feeding = feeding.filter(in_months(to_grain("__period", spec.grain), periods))
        gold = merge_states(feeding, spec, whole.schema)
        _publish(gold.withColumn(MONTH, to_grain(period, "month")), path, periods)
    return read_fact(spark, path, otherwise=whole)


def _shift(month: Date, by: int) -> Date:
    years, rest = divmod(month.month - 1 + by, 12)
    return Date(month.year + years, rest + 1, 1)


def _period_months(month: Date | None, grain: str) -> list[Date | None]:
    """Months in which the periods touching a month begin."""
    if month is None:
        return [None]
    return {"year": [month.replace(month=1)], "week": [_shift(month, -1), month]}.get(grain_unit(grain), [month])


def _feeding_months(first: Date | None, grain: str) -> list[Date | None]:
    """Months holding rows of the periods that begin in a month."""
    if first is None:
        return [None]
    ahead = {"year": 11, "week": 1}.get(grain_unit(grain), 0)
    return [_shift(first, n) for n in range(ahead + 1)]


def _write_months(rows: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write ``rows`` as a run and give its name and its months.

    The rebalance hint gathers each month's rows and splits large months into files of the advisory size.
    """
    spark, run = rows.sparkSession, f"run={uuid.uuid4().hex}"
    rows.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH).parquet(f"{path}/runs/{run}")
    return run, [n.removeprefix(f"{MONTH}=") for n in folder_names(spark, f"{path}/runs/{run}") if n.startswith(f"{MONTH}=")]


def _publish(rows: DataFrame, path: str, months: Collection[Date | None] | None = None) -> None:
    """Make ``rows`` the content of ``months`` (of the whole table when None); an index of keys goes."""
    spark = rows.sparkSession
    number, state = _newest(spark, path)
    run, filled = _write_months(rows, path)
    gone = {NO_MONTH if m is None else m.isoformat() for m in months or ()}
    before = state if months is not None else {}
    kept = {m: r for m, r in before.get("months", {}).items() if m not in gone}
    manifests.publish(spark, path, number + 1, {
        "months": kept | dict.fromkeys(filled, run), "schema": _without_month(_with_schema(spark, before, rows)).jsonValue()})
    _remove_unnamed(spark, path)


def _named_folders(content: dict) -> list[str]:
    months = content.get("months", content if "keys" not in content else {})
    index = content.get("keys") or {"runs": []}
    return [f"runs/{run}/{MONTH}={m}" for m, run in months.items()] + [f"keys/{run}" for run, _ in index["runs"]]


def _remove_unnamed(spark: SparkSession, path: str) -> None:
    """Remove all manifests but the last two, and folders that only those name."""
    manifests.remove_unnamed(spark, path, _named_folders)


def remove_strays(spark: SparkSession, path: str, older_than_hours: float = 24) -> list[str]:
    """Remove the folders of runs that broke off; runs that are under way must be younger than that."""
    return manifests.remove_strays(spark, path, ("runs", "keys"), _named_folders, older_than_hours)
