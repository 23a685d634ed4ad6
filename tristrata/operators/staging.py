"""Bronze: typed staging of source tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def stage(df: DataFrame, casts: Mapping[str, str] | None = None, drop_types: Sequence[type] = ()) -> DataFrame:
    """Explicit column list in schema order; dates as DATE, timestamps as zone-less TIMESTAMP_NTZ.

    ``casts`` adds types the source does not declare (dates in text, money in doubles). Columns of a type in
    ``drop_types`` are left out; ``unsupported_columns`` lists them.
    """
    casts = casts or {}
    unknown = [c for c in casts if c not in df.columns]
    if unknown:
        raise ValueError(f"stage: no such column(s) to cast: {', '.join(unknown)}")
    selected = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if field.name in casts:
            column = column.cast(casts[field.name])
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, tuple(drop_types)):
            continue
        selected.append(column.alias(field.name))
    return df.select(*selected)


def unsupported_columns(tables: Mapping[str, DataFrame], drop_types: Sequence[type]) -> DataFrame:
    """Report of the columns ``stage`` leaves out: one row per table and column."""
    rows = [(name, f.name, f.dataType.simpleString())
            for name, df in tables.items() for f in df.schema if isinstance(f.dataType, tuple(drop_types))]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
