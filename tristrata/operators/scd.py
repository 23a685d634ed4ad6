"""Slowly changing dimensions of type 2.

A snapshot holds the source's columns plus ``valid_from`` and ``valid_to`` (zone-less timestamps, half-open,
NULL while current). Its versions of one key never overlap and at most one is open.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tristrata.functions.columns import check_columns, common_schema, fitted, require
from tristrata.operators.dedup import dedup_latest
from tristrata.operators.diff import pair_versions
from tristrata.operators.hotkeys import HOT_KEY_ROWS, PIECE, bounds_of, hot_keys, in_pieces, only_hot, with_ends, without_hot

VALIDITY = ("valid_from", "valid_to")


def _instant(value: datetime | str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _open_version(row: str, columns: Sequence[str], valid_from: Column) -> Column:
    return F.struct(*(F.col(f"{row}.{c}").alias(c) for c in columns), valid_from.alias("valid_from"),
                    F.lit(None).cast("timestamp_ntz").alias("valid_to"))


def _merge(
    previous: DataFrame | None, source: DataFrame, key: Sequence[str], changed: Column, starts: Column,
    gone_at: Column | None,
) -> DataFrame:
    """Advance a snapshot by one source state; ``changed`` and ``starts`` may use ``old`` and ``new``.

    Columns that only one side has are NULL on the other, and types are widened.
    """
    columns = source.columns
    if previous is None:
        first = source.select(F.struct(*columns).alias("new"))
        return first.select(_open_version("new", columns, starts).alias("row")).select("row.*")
    require(previous, [*key, *VALIDITY], "snapshot")
    schema = common_schema(source.sparkSession, source.schema, previous.drop(*VALIDITY).schema)
    source, columns = fitted(source, schema), schema.names
    previous = fitted(previous, T.StructType([*schema, *(T.StructField(v, T.TimestampNTZType()) for v in VALIDITY)]))
    current = previous.filter(F.col("valid_to").isNull())
    pairs = pair_versions(current, source, key, [*columns, "valid_from"], columns)

    kept = _open_version("old", columns, F.col("old.valid_from"))
    opened = _open_version("new", columns, starts)
    closed = kept.withField("valid_to", starts)
    gone = kept if gone_at is None else kept.withField("valid_to", gone_at)
    rows = (F.when(F.col("old").isNull(), F.array(opened)).when(F.col("new").isNull(), F.array(gone))
             .when(changed, F.array(closed, opened)).otherwise(F.array(kept)))
    advanced = pairs.select(F.explode(rows).alias("row")).select("row.*")
    return previous.filter(F.col("valid_to").isNotNull()).unionByName(advanced)


def snapshot_check(
    previous: DataFrame | None, source: DataFrame, key: Sequence[str], run_at: datetime | str,
    columns: Sequence[str] | None = None, close_missing: bool = False, order_by: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Next snapshot when the source has no reliable update stamp.

    A key whose check columns differ (null-safe) from its current version gets that version closed and a new
    one opened at ``run_at``; unchanged keys keep their version, new keys open one. Keys missing from the
    source stay current unless ``close_missing``. Closed versions pass through without a shuffle. Of several
    source rows with one key the greatest by ``order_by`` counts; ``unique`` promises there are none.
    """
    columns = list(columns or check_columns(source, list(key)))
    require(source, [*key, *columns], "snapshot_check")
    source = source if unique else dedup_latest(source, key, order_by)

    def values(side: str) -> Column:
        return F.struct(*(F.col(f"{side}.{c}") for c in columns))

    at = _instant(run_at)
    return _merge(previous, source, key, ~values("old").eqNullSafe(values("new")), at,
                  at if close_missing else None)


def snapshot_timestamp(
    previous: DataFrame | None, source: DataFrame, key: Sequence[str], updated_at: str,
    run_at: datetime | str | None = None, close_missing: bool = False, unique: bool = False,
) -> DataFrame:
    """Next snapshot from a reliable update stamp: a newer stamp than the current version's start opens a
    version that starts at the stamp, whether or not a value changed. ``run_at`` closes missing keys. Of
    several source rows with one key the newest counts; ``unique`` promises there are none.

    A row without a stamp opens a version of a new key only: at ``run_at``, without that at no instant (NULL), which is
    older than any stamp."""
    require(source, [*key, updated_at], "snapshot_timestamp")
    source = source if unique else dedup_latest(source, key, [updated_at])
    if close_missing and run_at is None:
        raise ValueError("close_missing needs run_at, the instant at which missing keys are closed")
    stamp = F.col(f"new.{updated_at}").cast("timestamp_ntz")
    newer = stamp.isNotNull() & (F.col("old.valid_from").isNull() | (stamp > F.col("old.valid_from")))
    starts = stamp if run_at is None else F.coalesce(stamp, _instant(run_at))
    return _merge(previous, source, key, newer, starts, _instant(run_at) if close_missing else None)


def scd2_from_history(
    history: DataFrame, key: Sequence[str], at: str, columns: Sequence[str] | None = None,
    tiebreak: Sequence[str] = (), hot_key_rows: int | None = HOT_KEY_ROWS,
) -> DataFrame:
    """All versions at once from a change log: key, columns, ``valid_from``, ``valid_to``, ``is_current``.

    Rows of one key at one instant are reduced to the last by ``tiebreak``; runs of equal values (null-safe)
    become one version. Keys with more than ``hot_key_rows`` rows are cut into pieces of time, see ``hotkeys`` (None
    turns this off). No job runs while the plan is made.
    """
    columns = list(columns or check_columns(history, [*key, at]))
    require(history, [*key, at, *columns, *tiebreak], "scd2_from_history")
    raw = history.select(*key, at, *dict.fromkeys([*columns, *tiebreak]))
    if hot_key_rows is None:
        versions = _versions(raw, key, at, columns, tiebreak)
    else:
        hot = hot_keys(raw, key, hot_key_rows)
        versions = _versions(without_hot(raw, hot, key), key, at, columns, tiebreak)
        versions = versions.unionByName(_versions_in_pieces(raw, hot, key, at, columns, tiebreak))
    return versions.select(*key, *columns, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


def _versions(raw: DataFrame, key: Sequence[str], at: str, columns: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Dealt by key once: the aggregate and both windows need nothing else."""
    log = dedup_latest(raw.repartition(*key), [*key, at], tiebreak)
    values, in_order = F.struct(*columns), Window.partitionBy(*key).orderBy(at)
    changes = log.withColumn("__before", F.lag(values).over(in_order)).filter(~values.eqNullSafe(F.col("__before")))
    versions = changes.select(*key, *columns, F.col(at).cast("timestamp_ntz").alias("valid_from"))
    return versions.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from")))


def _versions_in_pieces(raw: DataFrame, hot: DataFrame, key: Sequence[str], at: str, columns: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """The versions of hot keys: a row is compared with the one before in its piece, the first of a piece with the last of
    the piece before; a version ends where the next starts, which for the last of a piece is the first of a later one."""
    bounds = bounds_of(raw, hot, key, at)
    log = dedup_latest(only_hot(raw, hot, key), [*key, at], tiebreak)
    log, inside, ends = with_ends(in_pieces(log, bounds, key, at), key, [at])
    values = F.struct(*columns)
    before = F.when(F.col("__first"), F.lag(values).over(ends)).otherwise(F.lag(values).over(inside))
    changes = log.withColumn("__before", before).filter(~values.eqNullSafe(F.col("__before")))
    versions = changes.select(*key, *columns, F.col(at).cast("timestamp_ntz").alias("valid_from"), PIECE)
    versions, inside, ends = with_ends(versions, key, ["valid_from"])
    following = F.when(F.col("__last"), F.lead("valid_from").over(ends)).otherwise(F.lead("valid_from").over(inside))
    return versions.withColumn("valid_to", following).select(*key, *columns, "valid_from", "valid_to")
