"""Broadcast only what has been measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 20_000
MAX_BYTES = 64 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) * 2 + 16
    return F.lit(16)


def small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows of together at most about max_bytes; otherwise as it is,
    for a shuffled join.

    The count stops at max_rows + 1 rows."""
    width = reduce(lambda a, b: a + b, [_bytes(f.name, f.dataType) for f in df.schema], F.lit(0)).cast("long")
    rows, size = df.limit(max_rows + 1).select(width.alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df
