"""Surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Keys already stored in a warehouse stay valid only with this separator and NULL marker.
SEPARATOR = "-"
NULL_MARKER = "_dbt_utils_surrogate_key_null_"


def surrogate_key(columns: Sequence[str | Column], length_prefixed: bool = False) -> Column:
    """MD5 over the listed columns, NULLs marked.

    The plain form can collide when text values contain the separator; ``length_prefixed`` writes each
    value's length in front of it and cannot.
    """
    texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARKER))
             for c in columns]
    if length_prefixed:
        texts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.md5(F.concat_ws(SEPARATOR, *texts))
