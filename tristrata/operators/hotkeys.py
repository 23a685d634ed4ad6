"""Windows over keys of any size: the rows of a hot key are cut into pieces of equal numbers of rows in time.

Which keys are hot, and where their pieces begin, is part of the plan: a count per key, and quantiles of the times of
hot keys only. Pieces are windowed apart. What a piece has to know of the others is found among their first and last
rows, two for each piece, which meet in a small window of their own; so no task holds more than a piece, also where a
key has all its rows within one second.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

# A key with more rows than this is cut up.
HOT_KEY_ROWS = 5_000_000

# From this limit on the list of hot keys, at most a row per so many rows of input, is broadcast.
BROADCAST_LIMIT = 1_000_000

# Pieces of a hot key; number of the piece of a row.
PIECES = 256
PIECE = "__piece"


def _same(key: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(key)))


def hot_keys(df: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """The keys with more than ``limit`` rows, counted map-side, as ``__h0``, ``__h1`` …"""
    named = [F.col(k).alias(f"__h{i}") for i, k in enumerate(key)]
    found = df.groupBy(*named).count().filter(F.col("count") > limit).drop("count")
    return F.broadcast(found) if limit >= BROADCAST_LIMIT else found


def without_hot(df: DataFrame, hot: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(hot, _same(key), "left_anti")


def only_hot(df: DataFrame, hot: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(hot, _same(key), "left_semi")


def bounds_of(df: DataFrame, hot: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Where the pieces of each hot key begin, as ``__bounds`` beside the key."""
    quantiles = F.percentile_approx(F.col(at).cast("timestamp_ntz"), [i / PIECES for i in range(1, PIECES)])
    return df.select(*key, at).join(hot, _same(key)).groupBy(*(f"__h{i}" for i in range(len(key)))).agg(quantiles.alias("__bounds"))


def in_pieces(df: DataFrame, bounds: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """The rows of hot keys with their ``PIECE``; rows without a time are in the first."""
    before = F.filter("__bounds", lambda b: b <= F.col(at).cast("timestamp_ntz"))
    marked = df.join(bounds, _same(key)).withColumn(PIECE, F.greatest(F.coalesce(F.size(before), F.lit(0)), F.lit(0)))
    return marked.select(*df.columns, PIECE)


def with_ends(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """``df`` with ``__first`` and ``__last`` of each piece, the window of a piece, and that of all ends of a key."""
    inside = Window.partitionBy(*key, PIECE).orderBy(*order)
    df = df.withColumns({"__first": F.row_number().over(inside) == 1, "__last": F.lead(F.lit(1)).over(inside).isNull()})
    group = F.when(F.col("__first") | F.col("__last"), F.lit(-1)).otherwise(F.col(PIECE))
    return df, inside, Window.partitionBy(*key, group).orderBy(*order)
