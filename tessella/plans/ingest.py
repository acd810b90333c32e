"""Ingestion: documents to versions, chunks, embeddings, staged and activated; and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import IngestionError
from tessella.functions.identity import version_id
from tessella.operators.chunk import recursive_chunks, recursive_fingerprint
from tessella.operators.embed import embedded, embedded_once
from tessella.operators.versions import invalid_versions
from tessella.plans.config import Config
from tessella.sources.cache import CacheTable
from tessella.sources.store import ChunkStore


def versioned(documents: DataFrame, provider, chunking: str) -> DataFrame:
    """documents with document_version: the same content, settings and bounds give the same version."""
    given = {"version_status": F.lit("active"), "version_revision": F.lit(1), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp"), "supersedes_version_id": F.lit(None).cast("string")}
    documents = documents.withColumns({k: v for k, v in given.items() if k not in documents.columns})
    c = F.col
    return documents.withColumn(
        "document_version",
        version_id(
            tenant=c("tenant_id"), collection=c("collection"), document=c("document_id"), status=c("status"), content=c("content"), metadata=c("metadata"), space=F.lit(provider.space.fingerprint),
            chunking=F.lit(chunking), version_status=c("version_status"), revision=c("version_revision"), valid_from=c("valid_from"), valid_until=c("valid_until"), supersedes=c("supersedes_version_id"),
        ),
    )


def ingest(documents: DataFrame, store: ChunkStore, provider, config: Config = Config(), *, chunker=None, chunking: str | None = None, cache: CacheTable | None = None) -> DataFrame:
    """Documents into the store; returns the report, a row a document: state, chunks, batches.

    A document without chunks, or with an invalid version, fails alone; with fail_fast it fails the run before anything is activated."""
    chunker = chunker or (lambda d: recursive_chunks(d, size=config.chunk_size, overlap=config.chunk_overlap))
    documents = versioned(documents, provider, chunking or recursive_fingerprint(config.chunk_size, config.chunk_overlap))
    space = provider.space
    key = ["tenant_id", "collection", "document_id", "document_version"]
    versions = documents.select(*key, F.lit(space.fingerprint).alias("embedding_space_fingerprint")).distinct()
    bad = invalid_versions(documents.withColumnRenamed("document_version", "version_id")).select("document_id", F.col("version_id").alias("document_version"), "problem")
    store.begin(versions)
    chunks = chunker(documents.join(bad, ["document_id", "document_version"], "left_anti"))
    if cache is None:
        chunks = embedded(chunks, provider, batch=config.batch_size, concurrency=config.concurrency)
    else:
        chunks, new = embedded_once(chunks, provider, cache.rows(), batch=config.batch_size, concurrency=config.concurrency)
        cache.add(new)
    rows = chunks.withColumns(
        {
            "embedding_provider": F.lit(space.provider), "embedding_model": F.lit(space.model), "embedding_dimensions": F.lit(space.dimensions), "embedding_revision": F.lit(space.revision),
            "embedding_space_fingerprint": F.lit(space.fingerprint), "ingestion_state": F.lit("staged"),
        }
    )
    store._append(rows, store._seq())
    staged = store.rows().where("ingestion_state in ('staged', 'active')").join(versions, [*key, "embedding_space_fingerprint"], "left_semi")
    counts = staged.groupBy(*key).agg(F.count("*").alias("chunks"))
    report = versions.join(counts, key, "left").join(bad, ["document_id", "document_version"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    problem = F.coalesce("problem", F.when(F.col("chunks") == 0, "no chunks"))
    report = report.select(*key, "embedding_space_fingerprint", "chunks", F.ceil(F.col("chunks") / config.batch_size).cast("int").alias("batches"), F.when(problem.isNull(), "active").otherwise("failed").alias("state"), problem.alias("problem"))
    # the report decides what is activated: it is computed once, before that
    report = _kept(report, store)
    failed, good = report.where("state = 'failed'"), report.where("state = 'active'")
    if not failed.isEmpty():
        store.fail(failed)
        if config.fail_fast:
            raise IngestionError("a document failed; nothing was activated", report)
    if not good.isEmpty():
        store.activate(good)
    return report


def _kept(report: DataFrame, store: ChunkStore) -> DataFrame:
    path = f"{store.root}/reports/{store._seq()}"
    report.write.parquet(path)
    return store.spark.read.parquet(path)


def totals(report: DataFrame) -> DataFrame:
    """Counts over a report: documents and how they ended, chunks, batches, those completed and those a failure affected."""
    return report.agg(
        F.count("*").alias("documents"), F.sum((F.col("state") == "active").cast("long")).alias("activated"), F.sum((F.col("state") == "failed").cast("long")).alias("failed"),
        F.sum("chunks").alias("chunks"), F.sum("batches").alias("batches"),
        F.sum(F.when(F.col("state") == "active", F.col("batches")).otherwise(0)).alias("completed_batches"), F.sum(F.when(F.col("state") == "failed", F.greatest("batches", F.lit(1))).otherwise(0)).alias("affected_batches"),
    )
