"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tristrata.sources.files import delete_path

_local_work_dirs: dict[str, str] = {}

# Runtime SQL settings: re-planning from measured sizes, and splitting of skewed join partitions even where
# that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Streaming state on local disk with incremental checkpoints instead of on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing (executors, shuffle partitions) stays the user's."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder; a cluster session must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_work_dirs:
        _local_work_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tristrata-")
    return _local_work_dirs[context.applicationId]


def new_work_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that nothing else uses."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def staged(df: DataFrame, label: str):
    """``df`` written to the work folder and read back: what follows starts from files, not from the lineage.

    The files go when the block has succeeded; after a failure they stay, as they may be the only copy.
    """
    spark, path = df.sparkSession, new_work_path(df.sparkSession, label)
    df.write.parquet(path)
    yield spark.read.schema(df.schema).parquet(path)
    delete_path(spark, path)
