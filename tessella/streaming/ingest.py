"""Continuous ingestion: every micro-batch of new files goes through the batch path.

Versions are content-addressed, so a batch that is repeated after a failure gives the same versions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.plans.config import Config
from tessella.plans.ingest import ingest
from tessella.sources.files import text_files
from tessella.sources.store import ChunkStore


def ingest_files(spark: SparkSession, path: str, store: ChunkStore, provider, checkpoint: str, *, tenant: str, config: Config = Config(), granularity: str = "whole_file", files_a_trigger: int = 1000) -> StreamingQuery:
    """A query that ingests all files of a folder, then those that arrive."""
    stream = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_trigger).text(path).select(F.col("_metadata.file_path").alias("path"), "value")

    def batch(rows: DataFrame, _: int) -> None:
        ingest(text_files(rows, tenant, granularity=granularity, collection=config.collection), store, provider, config)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream of events by type and window of event time; rows later than `late` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("starts"), "event_type", "n", "value")
