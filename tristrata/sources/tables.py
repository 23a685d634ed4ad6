"""Writing and re-reading tables of the bronze, silver and gold layers.

A full refresh goes to a new version folder; readers take the newest version whose job committed, so they
never see half a table and a table can be rebuilt from its own previous version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tristrata.functions.columns import common_schema
from tristrata.sources import manifests
from tristrata.sources.files import folder_names, path_exists

LAYERS = ("bronze", "silver", "gold", "snapshots")
# How much larger than what follows a run of closed versions must be to stay unmerged.
MERGE_FACTOR = 4


def layer_path(root: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; use one of {', '.join(LAYERS)}")
    return f"{root.rstrip('/')}/{layer}/{name}"


def staging_view_name(layer: str, table: str) -> str:
    return f"stg_{layer}_{table}"


def publish_view(df: DataFrame, layer: str, table: str) -> str:
    """Register a staged table as a view; nothing is written."""
    name = staging_view_name(layer, table)
    df.createOrReplaceTempView(name)
    return name


def _versions(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Highest version number in use, and the folders of the committed versions in order."""
    names = sorted(n for n in folder_names(spark, path) if n.startswith("v") and n[1:].isdigit())
    committed = [f"{path}/{n}" for n in names if path_exists(spark, f"{path}/{n}/_SUCCESS")]
    return max((int(n[1:]) for n in names), default=0), committed


def table_exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path)[1])


def _committed(spark: SparkSession, path: str) -> list[str]:
    committed = _versions(spark, path)[1]
    if not committed:
        raise FileNotFoundError(f"no committed version of a table below {path}")
    return committed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version."""
    return spark.read.parquet(_committed(spark, path)[-1])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Full refresh into the next version folder; older versions stay for the storage's clean-up rule."""
    spark = df.sparkSession
    target = f"{path}/v{_versions(spark, path)[0] + 1:09d}"
    df.write.partitionBy(*partition_by).parquet(target)
    return spark.read.schema(df.schema).parquet(target).select(df.columns)


def _snapshot_folders(content: dict) -> list[str]:
    return [f"runs/{run}/state=closed" for run, _ in content["closed"]] + ([f"runs/{content['open']}/state=open"] if content["open"] else [])


def _publish_run(advanced: DataFrame, path: str, number: int, before: dict) -> None:
    spark, run = advanced.sparkSession, f"run={uuid.uuid4().hex}"
    state = F.when(F.col("valid_to").isNull(), "open").otherwise("closed")
    advanced.withColumn("state", state).write.partitionBy("state").parquet(f"{path}/runs/{run}")
    filled, closed = folder_names(spark, f"{path}/runs/{run}"), list(before.get("closed", []))
    if "state=closed" in filled:
        closed.append([run, spark.read.schema(advanced.schema).parquet(f"{path}/runs/{run}/state=closed").count()])
    known = [T.StructType.fromJson(before["schema"])] if before else []
    schema = common_schema(spark, advanced.schema, *known)
    manifests.publish(spark, path, number + 1, {"open": run if "state=open" in filled else None, "closed": closed, "schema": schema.jsonValue()})
    manifests.remove_unnamed(spark, path, _snapshot_folders)


def write_snapshot(advanced: DataFrame, path: str) -> None:
    """Store one run of a snapshot: the versions it closed and all that are open now.

    Versions closed by earlier runs stay where those runs wrote them, so a run costs what is current, not the
    history. The manifest names the folder of the open versions and those of closed ones.
    """
    spark = advanced.sparkSession
    _publish_run(advanced, path, *manifests.newest(spark, path))
    compact_snapshot(spark, path)


def advance_snapshot(spark: SparkSession, path: str, advance: Callable[[DataFrame | None], DataFrame]) -> None:
    """Store the next run of a snapshot, as ``advance`` makes it from the open versions (None when there are none).

    If another writer stores a run meanwhile, ``advance`` starts again from what that one left open.
    """
    while True:
        number, before = manifests.newest(spark, path)
        try:
            _publish_run(advance(_open_versions(spark, path, before)), path, number, before)
        except FileExistsError:
            continue
        compact_snapshot(spark, path)
        return


def compact_snapshot(spark: SparkSession, path: str) -> None:
    """Merge the last runs of closed versions while those before are at most ``MERGE_FACTOR`` times as large as what follows.

    So their sizes fall by that factor, their number grows with the logarithm of the history, and so does the number of
    times a version is written. Published like a run: a merge that breaks off changes nothing.
    """
    number, content = manifests.newest(spark, path)
    closed = content.get("closed", [])
    first, rows = len(closed), 0
    while first and (not rows or closed[first - 1][1] <= MERGE_FACTOR * rows):
        first -= 1
        rows += closed[first][1]
    if len(closed) - first < 2:
        return
    run, schema = f"run={uuid.uuid4().hex}", T.StructType.fromJson(content["schema"])
    merged = spark.read.schema(schema).parquet(*(f"{path}/runs/{r}/state=closed" for r, _ in closed[first:]))
    merged.hint("rebalance").write.parquet(f"{path}/runs/{run}/state=closed")
    try:
        manifests.publish(spark, path, number + 1, {**content, "closed": [*closed[:first], [run, rows]]})
    except FileExistsError:  # another writer was first; the next run merges
        return
    manifests.remove_unnamed(spark, path, _snapshot_folders)


def _open_versions(spark: SparkSession, path: str, content: dict) -> DataFrame | None:
    if not content.get("open"):
        return None
    return spark.read.schema(T.StructType.fromJson(content["schema"])).parquet(f"{path}/runs/{content['open']}/state=open")


def read_open_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The current versions of a stored snapshot; None when there are none."""
    return _open_versions(spark, path, manifests.newest(spark, path)[1])


def read_snapshot(spark: SparkSession, path: str, otherwise: DataFrame | None = None) -> DataFrame:
    """All versions of a stored snapshot: those closed by any run, and those open after the last.

    Columns that a run did not have yet are NULL in its versions, and narrower types are read as the widest. Where no run
    has been stored, ``otherwise`` gives the columns.
    """
    content = manifests.newest(spark, path)[1]
    if not content:
        if otherwise is None:
            raise FileNotFoundError(f"no stored snapshot at {path}")
        return otherwise.limit(0)
    schema, folders = T.StructType.fromJson(content["schema"]), _snapshot_folders(content)
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def write_bucketed(df: DataFrame, table: str, buckets: int, columns: Sequence[str], path: str) -> DataFrame:
    """Catalogue table bucketed and sorted on ``columns``: joins and groupings on them need no shuffle.

    Tables joined often on one large key (an order key, say) should share the bucket count.
    """
    (df.write.bucketBy(buckets, *columns).sortBy(*columns).mode("overwrite")
       .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def write_profile(profile: DataFrame, path: str) -> None:
    """Export a profile as JSON lines."""
    profile.write.mode("overwrite").json(path)
