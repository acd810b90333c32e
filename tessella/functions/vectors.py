"""Distances between array<double> columns, and the deterministic hashing embedding."""

from __future__ import annotations

import math
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let

METRICS = ("cosine", "l2", "l1", "inner_product")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine clamped to [-1, 1]; 1 where a vector is all zero."""
    clamped = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))
    return let(norm(a) * norm(b), lambda lengths: F.when(lengths == 0, 1.0).otherwise(1 - clamped(dot(a, b) / F.nullif(lengths, F.lit(0.0)))))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "l1":
        return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "inner_product":
        return F.greatest(F.lit(0.0), 1 - dot(a, b))
    raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")


def is_valid(a: Column, dimensions: int) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return a.isNotNull() & (F.size(a) == dimensions) & F.forall(a, finite)


_TOKEN = re.compile(r"[\w-]+")


def hashed(text: str, dimensions: int) -> list[float]:
    """Unit vector: each token adds its sign and weight at crc32(token) modulo the dimensions."""
    vector = [0.0] * dimensions
    for token in _TOKEN.findall(text.lower()):
        h = zlib.crc32(token.encode())
        vector[h % dimensions] += (-1.0 if h & 2 else 1.0) * (1.5 if "_" in token or "-" in token else 1.0)
    length = math.sqrt(sum(x * x for x in vector))
    return [x / length for x in vector] if length else vector


def hashing_embedding(text: Column, dimensions: int = 32) -> Column:
    """hashed() of a column. As an expression it would run through all tokens once a dimension; in batches, once."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashed(t, dimensions) for t in texts], dtype=object)

    return embed(text)
