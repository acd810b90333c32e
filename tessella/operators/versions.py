"""Validity of document versions, and deletes and upserts on the chunk table as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("tenant_id", "collection", "chunk_id", "embedding_space_fingerprint", "document_version")


def is_valid_at(at: Column, valid_from: Column, valid_until: Column) -> Column:
    """Whether a version holds at a time; missing bounds are open."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_until.isNull() | (at < valid_until))


def conflicts(versions: DataFrame, *, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Each version with the first later one of its document that begins inside it.

    versions: keys, ord (the order of arrival), version_id, valid_from, valid_until."""
    left = versions.where(F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull()).select(*keys, F.col("ord").alias("i"), F.col("version_id").alias("left_version"), F.col("valid_from").alias("l_from"), F.col("valid_until").alias("l_until"))
    right = versions.where(F.col("valid_from").isNotNull()).select(*keys, F.col("ord").alias("j"), F.col("version_id").alias("right_version"), F.col("valid_from").alias("r_from"))
    met = left.join(right, list(keys)).where((F.col("i") < F.col("j")) & (F.col("l_from") <= F.col("r_from")) & (F.col("r_from") < F.col("l_until")))
    first = met.groupBy(*keys, "left_version").agg(F.min_by(F.struct("j", "right_version"), F.struct("i", "j")).alias("r"))
    return first.select(*keys, "left_version", F.col("r.right_version").alias("right_version"), F.lit("overlapping-validity-window").alias("reason"))


def invalid_versions(versions: DataFrame) -> DataFrame:
    """(document_id, version_id, problem)"""
    problem = F.when(F.col("valid_from") >= F.col("valid_until"), "valid_from is not before valid_until").when((F.col("version_status") == "draft") & F.col("valid_from").isNotNull(), "a draft has no valid_from")
    return versions.select("document_id", "version_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def check_batch(batch: DataFrame) -> None:
    """A batch is one tenant, collection and space, and has no key twice."""
    spread = batch.agg(*[F.count_distinct(c).alias(c) for c in ("tenant_id", "collection", "embedding_space_fingerprint")]).first()
    if any(n > 1 for n in spread):
        raise ValueError("a batch must not mix tenants, collections or embedding spaces")
    twice = batch.groupBy(*KEY).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"chunk {twice[0]['chunk_id']} occurs twice in a batch")


def latest(rows: DataFrame, *, keys: tuple[str, ...] = KEY, by: str = "seq") -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(by)))).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored after batch: known keys get content, metadata, status and embedding of the batch and keep everything else."""
    changed = [c for c in ("content", "metadata", "status", "embedding") if c in stored.columns]
    new = batch.select(*KEY, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__hit"))
    merged = stored.join(new, list(KEY), "left")
    kept = merged.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in stored.columns])
    return kept.unionByName(batch.join(stored.select(*KEY), list(KEY), "left_anti").select(*stored.columns))


def delete(stored: DataFrame, **equals) -> tuple[DataFrame, int]:
    """(what is left, how many rows went): rows for which all given columns are equal. A tenant must be given."""
    if not equals.get("tenant_id"):
        raise ValueError("a delete is for one tenant")
    hit = F.lit(True)
    for c, v in equals.items():
        if v is not None:
            hit = hit & (F.col(c) == v)
    return stored.where(~F.coalesce(hit, F.lit(False))), stored.where(hit).count()
