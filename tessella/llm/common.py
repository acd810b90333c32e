"""What the operators share: reading tables, cutting lineage into the shared folder, ids as text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and driver and executors are one process.
LOCAL_SHARED = "file:///tmp/checkpoints/tessella"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def cut(df: DataFrame, tag: str, *, outlives: bool = False) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back: later jobs do not depend on lost executors.

    outlives: the table stays when temporary() ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what was shuffled to make the table is of no use once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path  # type: ignore[attr-defined]
    if _scopes and not outlives:
        _scopes[-1].append(back)
    return back


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are cut inside are dropped at the end. For callers that have consumed, or cut elsewhere, what they need."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for made in held:
            drop_cut(made)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct `row`: beside it, no working column can clash with one of df's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of `row` again, some of them replaced."""
    return df.select(*[instead.get(c, F.col("row").getField(c)).alias(c) for c in names])


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of any name can't clash with working columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])
