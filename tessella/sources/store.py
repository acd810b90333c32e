"""A versioned chunk store of plain Parquet: chunks are appended, events say what holds.

    root/chunks   one append a batch, partitioned by tenant and collection
    root/events   (seq, tenant, collection, document, space, version, event): begin, stage, activate, fail, delete...

A batch becomes visible by one appended event after its chunks are written, so readers see all of it or nothing.
State is derived: of a document's activated versions the latest is active, earlier ones are superseded.

Reading prunes partitions by tenant and collection. Texts and vectors are never sorted or grouped: deletes, states and
rewritten keys are worked out on ids alone and then met by equal keys, by broadcast where they are counted as few.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import EngineError
from tessella.functions.sizes import small
from tessella.functions.identity import direct_version
from tessella.operators.versions import KEY, check_batch
from tessella.schema import CHUNKS, check

EVENTS = "seq long, event string, tenant_id string, collection string, document_id string, document_version string, embedding_space_fingerprint string, chunk_id string"
_DOCUMENT = ["tenant_id", "collection", "document_id", "embedding_space_fingerprint"]


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._stored = T.StructType([*CHUNKS.fields, T.StructField("seq", T.LongType(), False)])

    def _read(self, name: str, schema) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def _log(self, rows: DataFrame) -> None:
        known = {f.split()[0]: F.col(f.split()[0]) if f.split()[0] in rows.columns else F.lit(None).cast(f.split()[1]) for f in EVENTS.split(", ")}
        rows.select(*[c.alias(n) for n, c in known.items()]).write.mode("append").parquet(f"{self.root}/events")

    def _seq(self) -> int:
        return time.time_ns()

    def _append(self, batch: DataFrame, seq: int) -> None:
        check(batch).select(*[F.col(f.name).cast(f.dataType) for f in CHUNKS]).withColumn("seq", F.lit(seq)).write.mode("append").partitionBy("tenant_id", "collection").parquet(f"{self.root}/chunks")

    def store(self, batch: DataFrame) -> None:
        """Add or replace chunks that are active at once; an empty batch does nothing."""
        version = direct_version(F.col("tenant_id"), F.col("collection"), F.col("document_id"), F.col("embedding_space_fingerprint"))
        batch = batch.withColumns({"document_version": version, "ingestion_state": F.lit("active"), "version_revision": F.lit(1)})
        if batch.isEmpty():
            return
        check_batch(batch)
        seq = self._seq()
        self._append(batch, seq)
        self._log(batch.select(*_DOCUMENT, "document_version").distinct().withColumns({"seq": F.lit(seq), "event": F.lit("store")}))

    def begin(self, versions: DataFrame) -> None:
        """Forget what earlier runs left of these versions, unless it is active."""
        self._log(versions.select(*_DOCUMENT, "document_version").withColumns({"seq": F.lit(self._seq()), "event": F.lit("begin")}))

    def stage(self, batch: DataFrame) -> None:
        if batch.isEmpty():
            return
        check_batch(batch)
        self._append(batch.withColumn("ingestion_state", F.lit("staged")), self._seq())

    def stage_many(self, batches: DataFrame) -> None:
        """Stage batches of many tenants, collections and spaces at once; no key may occur twice."""
        twice = batches.groupBy(*KEY).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"chunk {twice[0]['chunk_id']} occurs twice in a batch")
        self._append(batches.withColumn("ingestion_state", F.lit("staged")), self._seq())

    def activate(self, versions: DataFrame) -> None:
        """Make staged versions the active ones; an error if one has no chunks."""
        staged = self.rows().where(F.col("ingestion_state").isin("staged", "active"))
        empty = versions.join(staged, [*_DOCUMENT, "document_version"], "left_anti").limit(1).collect()
        if empty:
            raise EngineError(f"document {empty[0]['document_id']} has no staged chunks")
        self._log(versions.select(*_DOCUMENT, "document_version").withColumns({"seq": F.lit(self._seq()), "event": F.lit("activate")}))

    def fail(self, versions: DataFrame) -> None:
        self._log(versions.select(*_DOCUMENT, "document_version").withColumns({"seq": F.lit(self._seq()), "event": F.lit("fail")}))

    def rows(self, tenants: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
        """All chunks that are not deleted, with their present state; of a key's rows the newest content, the oldest
        position. With tenants or collections only theirs are read."""
        chunks, events = self._read("chunks", self._stored), self.events()
        if tenants is not None:
            chunks, events = (df.where(F.col("tenant_id").isin(tenants)) for df in (chunks, events))
        if collections is not None:
            chunks, events = chunks.where(F.col("collection").isin(collections)), events.where(F.col("collection").isin(collections) | F.col("collection").isNull())
        rows = self._undeleted(chunks, events.where(F.col("event").startswith("delete")))
        rows = rows.join(small(self._of_version(events)), [*_DOCUMENT, "document_version"], "left")
        # what was staged before the version was begun anew is gone, unless it became active meanwhile
        rows = rows.where(F.col("begun").isNull() | (F.col("seq") > F.col("begun")) | F.coalesce(F.col("activated") < F.col("begun"), F.lit(False)))
        again = rows.groupBy(*KEY).agg(F.max("seq").alias("newest_seq"), F.min_by("position", "seq").alias("first_position"), F.count("*").alias("n")).where("n > 1").drop("n")
        rows = rows.join(small(again), list(KEY), "left").where(F.col("newest_seq").isNull() | (F.col("seq") == F.col("newest_seq")))
        now = F.when(F.col("activated").isNotNull() & (F.col("activated") >= F.col("seq")), F.when(F.col("activated") == F.col("newest"), "active").otherwise("superseded"))
        now = now.when(F.col("failed") > F.col("seq"), "failed").otherwise("staged")
        return rows.withColumns({"ingestion_state": now, "position": F.coalesce("first_position", "position")}).select(*[f.name for f in CHUNKS])

    def _of_version(self, events: DataFrame) -> DataFrame:
        """A row a document version: when it was last activated, begun and failed, and the document's newest activation."""
        of_version = events.where(~F.col("event").startswith("delete")).groupBy(*_DOCUMENT, "document_version").agg(
            F.max(F.when(F.col("event").isin("activate", "store"), F.col("seq"))).alias("activated"),
            F.max(F.when(F.col("event") == "begin", F.col("seq"))).alias("begun"),
            F.max(F.when(F.col("event") == "fail", F.col("seq"))).alias("failed"),
        )
        return of_version.withColumn("newest", F.max("activated").over(Window.partitionBy(*_DOCUMENT)))

    def _undeleted(self, chunks: DataFrame, gone: DataFrame) -> DataFrame:
        """chunks without those that a later delete names. Deletes that name the same columns are one join on them."""
        named = [c for c in ("collection", "document_id", "embedding_space_fingerprint", "chunk_id")]
        forms = gone.select(*[F.col(c).isNotNull().alias(c) for c in named]).distinct().collect()  # at most 16 rows
        for form in forms:
            keys = ["tenant_id", *[c for c in named if form[c]]]
            same = F.lit(True)
            for c in named:
                same = same & (F.col(c).isNotNull() if form[c] else F.col(c).isNull())
            last = gone.where(same).groupBy(*keys).agg(F.max("seq").alias("gone_at"))
            chunks = chunks.join(small(last), keys, "left").where(F.col("gone_at").isNull() | (F.col("seq") > F.col("gone_at"))).drop("gone_at")
        return chunks

    def active(self, tenants: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
        return self.rows(tenants, collections).where("ingestion_state = 'active'")

    def _delete(self, event: str, equals: dict) -> int:
        hit = F.lit(True)
        for c, v in equals.items():
            if v is not None:
                hit = hit & (F.col(c) == v)
        n = self.rows([equals["tenant_id"]]).where(hit).count()
        values = {**dict.fromkeys(["collection", "document_id", "embedding_space_fingerprint", "chunk_id"]), **equals}
        row = self.spark.range(1).select(*[F.lit(v).cast("string").alias(c) for c, v in values.items()], F.lit(self._seq()).alias("seq"), F.lit(event).alias("event"))
        self._log(row)
        return n

    def delete_chunk(self, tenant_id: str, collection: str, chunk_id: str, embedding_space_fingerprint: str) -> int:
        return self._delete("delete_chunk", {"tenant_id": tenant_id, "collection": collection, "chunk_id": chunk_id, "embedding_space_fingerprint": embedding_space_fingerprint})

    def delete_document(self, tenant_id: str, document_id: str | None = None, collection: str | None = None, embedding_space_fingerprint: str | None = None) -> int:
        return self._delete("delete_document", {"tenant_id": tenant_id, "document_id": document_id, "collection": collection, "embedding_space_fingerprint": embedding_space_fingerprint})

    def clear_collection(self, tenant_id: str, collection: str) -> int:
        return self._delete("delete_collection", {"tenant_id": tenant_id, "collection": collection})
