"""The chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.errors import IncompatibleSchemaError

_TEXT = "chunk_id document_id document_version ingestion_state tenant_id collection status content".split()
CHUNKS = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in _TEXT]
    + [
        T.StructField("position", T.IntegerType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embedding", T.ArrayType(T.DoubleType()), False),
        T.StructField("embedding_provider", T.StringType(), False),
        T.StructField("embedding_model", T.StringType(), False),
        T.StructField("embedding_dimensions", T.IntegerType(), False),
        T.StructField("embedding_revision", T.StringType(), False),
        T.StructField("embedding_space_fingerprint", T.StringType(), False),
        T.StructField("version_status", T.StringType()),
        T.StructField("version_revision", T.IntegerType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_until", T.TimestampType()),
        T.StructField("supersedes_version_id", T.StringType()),
    ]
)
STATES = ("staged", "active", "failed", "superseded")


def check(df: DataFrame, needed: T.StructType = CHUNKS) -> DataFrame:
    """df, if it has all needed columns; one error names all that it lacks."""
    missing = [f.name for f in needed if f.name not in df.columns]
    if missing:
        raise IncompatibleSchemaError(missing)
    return df
