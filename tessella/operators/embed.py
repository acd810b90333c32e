"""Embeddings: providers, batches, and a cache that asks a provider once for equal texts."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import BatchWindowError, InvalidEmbeddingError, ProviderError
from tessella.functions.identity import EmbeddingSpace
from tessella.functions.vectors import hashing_embedding, is_valid
from tessella.sources.scratch import written

BATCH = 32


class Provider(Protocol):
    space: EmbeddingSpace

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashingProvider:
    """Deterministic and offline."""

    def __init__(self, dimensions: int = 32):
        self.space = EmbeddingSpace("offline", f"token-hash-{dimensions}", dimensions)

    def column(self, text):
        return hashing_embedding(text, self.space.dimensions)


def check_url(url: str) -> str:
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname or parts.username or parts.query or parts.fragment:
        raise ValueError("an address is http or https, without credentials, query or fragment")
    return url.rstrip("/")


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 60) -> dict:
    """The reply's JSON; failures name the address but repeat nothing of the bodies."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:  # noqa: S310 - checked by check_url
            return json.loads(reply.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise ProviderError(f"{url} failed: {type(e).__name__}") from e


def checked(vectors: list, n: int, dimensions: int) -> list[list[float]]:
    if len(vectors) != n:
        raise InvalidEmbeddingError(f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if len(v) != dimensions or not all(isinstance(x, (int, float)) and abs(x) < float("inf") for x in v):
            raise InvalidEmbeddingError("a vector has the wrong length or no finite numbers")
    return vectors


@dataclass
class IndexedHttpProvider:
    """An address /embeddings that returns vectors with the index of their text."""

    space: EmbeddingSpace
    base_url: str
    key: str | None = None
    post: Callable = post_json

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        reply = self.post(f"{check_url(self.base_url)}/embeddings", {"model": self.space.model, "input": list(texts), "dimensions": self.space.dimensions}, headers)
        by = {d["index"]: d["embedding"] for d in reply.get("data", ())}
        if sorted(by) != list(range(len(texts))) or len(reply["data"]) != len(texts):
            raise InvalidEmbeddingError("indices are missing or repeated")
        return checked([by[i] for i in range(len(texts))], len(texts), self.space.dimensions)


@dataclass
class PositionalHttpProvider:
    """An address /api/embed that returns vectors in the order of the texts."""

    space: EmbeddingSpace
    base_url: str
    post: Callable = post_json

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        reply = self.post(f"{check_url(self.base_url)}/api/embed", {"model": self.space.model, "input": list(texts)})
        return checked(reply.get("embeddings", []), len(texts), self.space.dimensions)


def in_windows(provider, texts: list[str], batch: int, concurrency: int) -> list[list[float]]:
    """Vectors of texts; one request for every `batch`, up to `concurrency` at a time."""
    parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    vectors: list[list[float]] = []
    with ThreadPoolExecutor(concurrency) as pool:
        for first in range(0, len(parts), concurrency):
            window = range(first, min(first + concurrency, len(parts)))
            asked = [pool.submit(lambda part: checked(provider.embed(part), len(part), provider.space.dimensions), parts[k]) for k in window]
            errors = [(k, f.exception()) for k, f in zip(window, asked) if f.exception() is not None]
            if errors:
                failed, cause = errors[0]
                raise BatchWindowError(failed, list(window), list(range(first)), [k for k in window if k not in dict(errors)]) from cause
            vectors += [v for f in asked for v in f.result()]
    return vectors


def embedded(rows: DataFrame, provider, *, text_col: str = "content", out: str = "embedding", batch: int = BATCH, concurrency: int = 1) -> DataFrame:
    """rows with vectors; one request for every `batch` texts of a partition, up to `concurrency` at a time."""
    if hasattr(provider, "column"):
        return rows.withColumn(out, provider.column(F.col(text_col)))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(in_windows(provider, texts.tolist(), batch, concurrency), dtype=object)

    return rows.withColumn(out, run(text_col))


def cache_key(tenant, space: EmbeddingSpace, text):
    return F.concat_ws(":", F.sha2(tenant, 256), F.lit(space.fingerprint), F.sha2(text, 256))


def embedded_once(rows: DataFrame, provider, cache: DataFrame | None = None, *, text_col: str = "content", out: str = "embedding", batch: int = BATCH, concurrency: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, new cache rows): equal texts of a tenant are embedded once, cached ones not at all.

    cache: cache_key, embedding. The new rows are to be appended to it."""
    keyed = rows.withColumn("cache_key", cache_key(F.col("tenant_id"), provider.space, F.col(text_col)))
    wanted = keyed.groupBy("cache_key").agg(F.first(text_col).alias(text_col))
    if cache is not None:
        wanted = wanted.join(cache, "cache_key", "left_anti")
    new = embedded(wanted, provider, text_col=text_col, batch=batch, concurrency=concurrency).select("cache_key", "embedding")
    if not hasattr(provider, "column"):
        new = written(new, "embedded")  # a provider is asked once, whoever reads the result
    known = new if cache is None else new.unionByName(cache.select("cache_key", "embedding"))
    return keyed.join(known.withColumnRenamed("embedding", out), "cache_key").drop("cache_key"), new


def assert_space(rows: DataFrame, space: EmbeddingSpace) -> None:
    bad = rows.where(~is_valid(F.col("embedding"), space.dimensions)).limit(1).count()
    if bad:
        raise InvalidEmbeddingError(f"a vector is not {space.dimensions} finite numbers")
