"""Exact vector search and lexical search for a DataFrame of questions.

Vectors are compared block by block (see operators.nearest); only a block's best k a question are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import lexical_tokens
from tessella.operators.nearest import nearest

SCOPE = ("tenant_id", "collection", "status", "embedding_space_fingerprint")
LIMIT, MAX_DISTANCE = 5, 0.45


def check_policy(limit: int, maximum_distance: float | None) -> None:
    if not 1 <= limit <= 100:
        raise ValueError("the limit must be from 1 to 100")
    if maximum_distance is not None and not maximum_distance >= 0:
        raise ValueError("the maximum distance can't be negative")


def in_state(chunks: DataFrame, *, valid_at=None, include_superseded: bool = False) -> DataFrame:
    """Active chunks; with valid_at those whose bounds are known and hold it."""
    if not include_superseded and "ingestion_state" in chunks.columns:
        chunks = chunks.where(F.col("ingestion_state") == "active")
    if valid_at is not None:
        at = valid_at if isinstance(valid_at, Column) else F.lit(valid_at).cast("timestamp")
        chunks = chunks.where((F.col("valid_from") <= at) & (F.col("valid_until") > at))
    return chunks


def ranked(rows: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def vector_search(chunks: DataFrame, queries: DataFrame, *, limit: int = LIMIT, metric: str = "cosine", maximum_distance: float | None = None, keys: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """(keys, chunk_id, document_id, distance, rank): each query's nearest chunks of its scope, ties by chunk id.

    queries: keys, query_embedding and any of the scope's columns. The threshold is applied before the ranking, which
    is the same for an exact search and keeps far rows out of the shuffle."""
    check_policy(limit, maximum_distance)
    keys = keys or ["question_id", "query"]
    names = [c for c in ["chunk_id", "document_id", *(carry or [])] if c in chunks.columns]
    scope = [c for c in SCOPE if c in queries.columns and c in chunks.columns]
    found = nearest(chunks, queries, keys=keys, names=names, scope=scope, metric=metric, limit=limit, maximum_distance=maximum_distance)
    return ranked(found, keys, limit, F.asc_nulls_last("distance"), F.col("chunk_id"))


_TOKEN = r"[\p{L}\p{N}_-]+"


def _anchored(asked: DataFrame) -> DataFrame:
    """asked (terms, tokens) with `anchor`: the longest of its tokens between its first and its last, null if there is none.

    Such a token has other characters on both sides, so a text that holds the whole question has it as a token."""
    every = F.regexp_extract_all(F.lower("terms"), F.lit(_TOKEN), F.lit(0))
    inner = F.when(F.size(every) > 2, F.slice(every, 2, F.greatest(F.lit(1), F.size(every) - 2))).otherwise(F.array().cast("array<string>"))
    # the longest is as a rule the rarest
    longest = F.element_at(F.array_sort(F.transform(F.array_intersect(inner, "tokens"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)
    return asked.withColumn("anchor", F.when(F.size(F.array_intersect(inner, "tokens")) > 0, longest["t"]))


def _holding(held: DataFrame, short: DataFrame, scope: list[str]) -> DataFrame:
    """(question_id, chunk columns) of the chunks that hold a whole question, for questions without an anchor.

    The chunk must have a token that holds the question's longest token. The tokens of all chunks are made distinct
    first, and of each only its parts of the questions' lengths are joined, so this too is a join on equal values."""
    part = F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))), -1)["t"]
    wanted = short.select("question_id", *scope, F.lower("terms").alias("terms"), part.alias("part"))
    lengths = sorted(r[0] for r in wanted.select(F.length("part")).distinct().collect())  # a row a length of a word
    pairs = held.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(_TOKEN), F.lit(0)))).alias("token"))

    def parts(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("token") - n + 1)
        return F.when(F.length("token") >= n, F.transform(places, lambda i: F.substring(F.col("token"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    words = pairs.select("token").distinct().select("token", F.explode(F.array_distinct(F.flatten(F.array(*map(parts, lengths))))).alias("part"))
    found = words.join(wanted, "part")
    return pairs.join(found, [*scope, "token"]).where(F.contains("low", "terms")).drop("low", "token", "terms", "part", *scope).distinct()


def lexical_search(chunks: DataFrame, questions: DataFrame, *, limit: int = 20, maximum_distance: float | None = None, carry: list[str] | None = None, few: int = 2000) -> DataFrame:
    """(question_id, chunk_id, document_id, lexical_score, distance, rank) by overlap of tokens.

    Each token of the question that the chunk has adds 1, or 1.4 if it holds - or _; the whole question inside the
    chunk adds 1 more; the score is per token of the question, repeats included. Order: score, then chunk id.

    Chunks meet questions by token, so that work follows the matches; a whole question is looked for only in chunks that
    have its anchor (see _anchored, _holding). At most `few` questions are sent to the chunks, which lie by chunk id: a
    pair's tokens are added up where they are, and no pair is shuffled. More questions are joined by shuffle."""
    check_policy(limit, maximum_distance)
    scope = [c for c in SCOPE[:3] if c in questions.columns and c in chunks.columns]
    names = [c for c in ["chunk_id", "document_id", *(carry or [])] if c in chunks.columns]
    keys = list(dict.fromkeys([*names, *scope]))
    tokens = lexical_tokens(F.col("content"))
    asked = _anchored(questions.select("question_id", *scope, F.col("content").alias("terms"), tokens.alias("tokens")).where(F.size("tokens") > 0))
    n_asked, n_tokens, n_bytes, n_short = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)), F.count_if(F.col("anchor").isNull())).first()
    sent = n_asked <= few and n_tokens <= 100 * few and n_bytes <= 4000 * few
    weight = F.when(F.col("token").rlike("[_-]"), 1.4).otherwise(1.0)
    each = asked.select("question_id", *scope, F.size("tokens").alias("n"), "anchor", F.lower("terms").alias("terms"), F.explode("tokens").alias("token"))
    by_token = each.groupBy("question_id", *scope, "n", "token").agg((F.count("*") * weight).alias("gain"), F.max(F.when(F.col("token") == F.col("anchor"), F.col("terms"))).alias("terms"))
    held = chunks.select(*keys, F.lower("content").alias("low"), F.array_distinct(tokens).alias("tokens"))
    bonus = F.when(F.col("terms").isNotNull() & F.contains("low", "terms"), 1.0).otherwise(0.0)
    if sent:
        held = held.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id")
        met = held.select(*keys, "low", F.explode("tokens").alias("token")).join(F.broadcast(by_token), [*scope, "token"])
        hits = met.select("question_id", "n", *names, (F.col("gain") + bonus).alias("hits"))
    else:
        met = held.select(*keys, F.explode("tokens").alias("token")).join(by_token, [*scope, "token"])
        hits = met.select("question_id", "n", *names, F.col("gain").alias("hits"))
        near = met.where("terms is not null").select("question_id", "n", "chunk_id", "terms").join(held.select(*names, "low"), "chunk_id")
        hits = hits.unionByName(near.where(F.contains("low", "terms")).select("question_id", "n", *names, F.lit(1.0).alias("hits")))
    if n_short:
        short = asked.where("anchor is null")
        whole = _holding(held.select(*keys, "low"), short, scope).join(short.select("question_id", F.size("tokens").alias("n")), "question_id")
        hits = hits.unionByName(whole.select("question_id", "n", *names, F.lit(1.0).alias("hits")))
    total = hits.groupBy("question_id", "n", *names).agg(F.sum("hits").alias("hits"))
    scored = total.select("question_id", *names, (F.col("hits") / F.col("n")).alias("lexical_score")).withColumn("distance", 1 / (1 + F.col("lexical_score")))
    if maximum_distance is not None:
        scored = scored.where(F.col("distance") <= maximum_distance)
    # sums of the same numbers in another order are the same score
    return ranked(scored, ["question_id"], limit, F.desc(F.round("lexical_score", 9)), F.col("chunk_id"))
