"""Reading source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def read_sources(
    spark: SparkSession, tables: Mapping[str, str], source_format: str = "parquet", **options
) -> dict[str, DataFrame]:
    """One lazy DataFrame per table.

    ``tables`` maps a table name to its path, or to its table name for the formats ``table`` (catalogue)
    and ``jdbc``. For JDBC pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``,
    or one task reads everything.
    """
    if source_format == "table":
        return {name: spark.table(location) for name, location in tables.items()}
    reader = spark.read.format(source_format).options(**options)
    if source_format == "jdbc":
        return {name: reader.option("dbtable", location).load() for name, location in tables.items()}
    return {name: reader.load(location) for name, location in tables.items()}


def read_folder(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """``read_sources`` over ``<folder>/<name>.parquet``."""
    return read_sources(spark, {name: f"{folder}/{name}.parquet" for name in names})


def read_partitioned(
    spark: SparkSession, parent: str | None = None, children: Sequence[str | DataFrame] = ()
) -> DataFrame:
    """Read a partitioned table as one relation.

    With ``parent`` its ``column=value`` folders are discovered (and pruned by filters). Otherwise the
    children, given as paths or DataFrames, are appended by column name; a column some lack becomes NULL.
    """
    if parent is not None:
        return spark.read.option("basePath", parent).parquet(parent)
    frames = [spark.read.parquet(c) if isinstance(c, str) else c for c in children]
    if not frames:
        raise ValueError("a partitioned table needs a parent folder or at least one child")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
