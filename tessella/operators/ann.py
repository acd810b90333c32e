"""Approximate vector search by inverted lists.

Centroids are fitted on a bounded sample (SAMPLE vectors, the least by hash of the id), every vector is put into the list
of its nearest centroid, and a query reads only the lists of its nearest centroids. Vectors of a list lie together in the
written index, partitioned by list, so a search scans the lists that some query reads. Distances are exact; what is
approximate is which vectors are looked at. `probes` = `lists` looks at all.

Lists have no bound: a list that holds many vectors is read by as many tasks as it has files.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.nearest import nearest
from tessella.operators.search import check_policy, ranked

SAMPLE = 20_000
LISTS = 64
ROUNDS = 10


class Index(NamedTuple):
    rows: DataFrame  # the vectors' rows with list_no
    centroids: np.ndarray
    metric: str


def _prepared(m: np.ndarray, metric: str) -> np.ndarray:
    """Vectors among which the nearest by Euclid are the nearest by the metric: of unit length for angles."""
    if metric in ("cosine", "inner_product"):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return m


def _far(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (m * m).sum(1)[:, None] - 2 * m @ centroids.T + (centroids * centroids).sum(1)[None, :]


def fit(vectors: DataFrame, *, id_col: str = "chunk_id", lists: int = LISTS, metric: str = "cosine", sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample, by rounds of k-means from random vectors of it."""
    rows = vectors.where("embedding is not null").select("embedding", F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    m = _prepared(np.array([r["embedding"] for r in rows], float), metric)
    centroids = m[np.random.default_rng(seed).permutation(len(m))[: min(lists, len(m))]]
    for _ in range(ROUNDS):
        own = _far(m, centroids).argmin(1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, m)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest_lists(column, centroids: np.ndarray, metric: str, k: int):
    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        m = _prepared(np.array(vectors.tolist(), float).reshape(len(vectors), -1), metric)
        return pd.Series(list(np.argsort(_far(m, centroids), axis=1, kind="stable")[:, :k].astype(np.int32)))

    return nearest(column)


def build(vectors: DataFrame, path: str | None = None, *, id_col: str = "chunk_id", lists: int = LISTS, metric: str = "cosine", sample: int = SAMPLE) -> Index:
    """An index of all rows of vectors that have an embedding; written to path, partitioned by list, if one is given."""
    held = vectors.where("embedding is not null")
    centroids = fit(held, id_col=id_col, lists=lists, metric=metric, sample=sample)
    rows = held.withColumn("list_no", F.element_at(_nearest_lists(F.col("embedding"), centroids, metric, 1), 1)) if len(centroids) else held.withColumn("list_no", F.lit(0))
    if path:
        spark = vectors.sparkSession
        rows.repartition("list_no", F.pmod(F.xxhash64(id_col), F.lit(8))).write.partitionBy("list_no").parquet(f"{path}/lists")
        spark.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centroids)], "list_no int, centroid array<double>, metric string").coalesce(1).write.parquet(f"{path}/centroids")
        return load(spark, path)
    return Index(rows, centroids, metric)


def load(spark: SparkSession, path: str) -> Index:
    held = spark.read.parquet(f"{path}/centroids").orderBy("list_no").collect()  # a row a list
    return Index(spark.read.parquet(f"{path}/lists"), np.array([r["centroid"] for r in held]), held[0]["metric"] if held else "cosine")


def search(index: Index, queries: DataFrame, *, limit: int = 5, probes: int = 16, maximum_distance: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, chunk_id, document_id, distance, rank) of the nearest rows in each query's `probes` nearest lists."""
    check_policy(limit, maximum_distance)
    keys = keys or ["question_id"]
    names = [c for c in ("chunk_id", "document_id") if c in index.rows.columns]
    if not len(index.centroids):
        index = index._replace(centroids=np.zeros((1, len(queries.first()["query_embedding"])) if not queries.isEmpty() else (1, 1)))
    asked = queries.withColumn("lists", _nearest_lists(F.col("query_embedding"), index.centroids, index.metric, probes))
    wanted = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]  # at most a row a list
    read = index.rows.where(F.col("list_no").isin(wanted))
    found = nearest(read, asked, keys=keys, names=names, scope=[], metric=index.metric, limit=limit, maximum_distance=maximum_distance, lists=True)
    return ranked(found, keys, limit, F.asc_nulls_last("distance"), F.col("chunk_id"))
