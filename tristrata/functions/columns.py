"""Reading a schema: which columns are dates, measures, update stamps or check columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tristrata.functions.names import (
    AUDIT_COLUMNS, AUDIT_DATES, IDENTIFIER_WORDS, MEASURE_WORDS, NO_MEASURES, TECHNICAL_COLUMNS, UPDATE_STAMPS,
)

DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
FRACTION_TYPES = (T.DecimalType, T.FloatType, T.DoubleType)


def is_date(field: T.StructField) -> bool:
    return isinstance(field.dataType, DATE_TYPES)


def is_measure(field: T.StructField) -> bool:
    """Fractional columns always; integers only when a part of the name begins or ends with a word that says so.

    Names that end in an identifier's word are none: ``orderqty`` is a measure, ``account_id`` is not.
    """
    if isinstance(field.dataType, FRACTION_TYPES):
        return True
    parts = field.name.lower().split("_")
    if not isinstance(field.dataType, T.IntegralType) or parts[-1] in IDENTIFIER_WORDS:
        return False
    return any(part.startswith(word) or part.endswith(word) for part in parts if part not in NO_MEASURES for word in MEASURE_WORDS)


def date_columns(df: DataFrame, audit: bool = True) -> list[str]:
    """Date and timestamp columns, business dates first; audit stamps follow unless ``audit`` is off."""
    dates = [f.name for f in df.schema if is_date(f)]
    business = [d for d in dates if d.lower() not in AUDIT_DATES]
    return business + [d for d in dates if d not in business] if audit else business


def update_stamp(df: DataFrame) -> str | None:
    """The column that says when a row last changed, if there is one."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[s] for s in UPDATE_STAMPS if s in by_lower), None)


def check_columns(df: DataFrame, key: list[str]) -> list[str]:
    """Columns whose change is a business change; all non-key columns when none qualifies."""
    others = [c for c in df.columns if c not in key]
    ignored = AUDIT_COLUMNS | TECHNICAL_COLUMNS
    return [c for c in others if c.lower() not in ignored] or others


def require(df: DataFrame, columns, where: str) -> None:
    """Raise a readable error when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: unknown column(s) {', '.join(missing)}; have {', '.join(df.columns)}")


def common_schema(spark: SparkSession, *schemas: T.StructType) -> T.StructType:
    """The columns of all schemas in order of first appearance, each of the widest of its types, as Spark widens unions.

    Text and other types have no common one: such a change raises.
    """
    texts: dict[str, set[bool]] = {}
    for field in (f for schema in schemas for f in schema):
        texts.setdefault(field.name, set()).add(isinstance(field.dataType, T.StringType))
    mixed = [name for name, kinds in texts.items() if len(kinds) > 1]
    if mixed:
        raise ValueError(f"column(s) {', '.join(mixed)} change between text and another type")
    frames = [spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema])) for schema in schemas]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).schema


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns and types of ``schema``; NULL in those it lacks."""
    types = {f.name: f.dataType for f in df.schema}
    if [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]:
        return df
    return df.select(*((F.col(f"`{f.name}`") if f.name in types else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
