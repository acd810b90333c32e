"""Caches that outlive a session: appended Parquet tables of keys and what was paid for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VECTORS, ANSWERS = "cache_key string, embedding array<double>", "prompt_key string, answer string"


class CacheTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def rows(self) -> DataFrame:
        """One row a key; where two runs paid for the same key, either of their rows."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        held = self.spark.read.schema(self.schema).parquet(self.path)
        return held.dropDuplicates([held.columns[0]])

    def add(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            rows.write.mode("append").parquet(self.path)
