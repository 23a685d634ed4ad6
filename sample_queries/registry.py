"""Registry pairing a Spark query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristrata.operators.staging import stage
from tristrata.session import tune
from tristrata.sources.readers import read_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name; ``sql`` is its counterpart, if SQL can express it."""
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(tune(spark), folder)

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            SQL[function.__name__] = sql
        return run
    return register


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: stage(df) for n, df in read_folder(spark, folder, names).items()}


def snap(df: DataFrame, **digits: int) -> DataFrame:
    """Round sums of doubles to the digits their terms have, so that summation order cannot show."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})
