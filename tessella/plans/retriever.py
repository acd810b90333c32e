"""Retrieval for a DataFrame of questions: rewrite, search, fuse, rerank, select, abstain, expand, budget."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.sizes import small
from tessella.operators import fulltext, fuse, search, select
from tessella.operators.embed import embedded, embedded_once
from tessella.plans.config import Config
from tessella.sources.cache import CacheTable
from tessella.sources.scratch import written


class Outcome(NamedTuple):
    results: DataFrame
    diagnostics: DataFrame
    stages: dict[str, DataFrame]


def lexical_ranking(chunks: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """Chunks that hold the words of the questions, by the scorer that the settings name."""
    limit = config.lexical_candidate_limit or config.candidate_limit
    if config.text_search == "overlap":
        return search.lexical_search(chunks, asked, limit=limit)
    return fulltext.fulltext_search(chunks, asked, limit=limit, analyser=config.text_search)


def retrieve(questions: DataFrame, chunks: DataFrame, provider, config: Config = Config(), *, relevance: select.RelevancePolicy | None = None, reranker=None, valid_at=None, cache: CacheTable | None = None) -> Outcome:
    """questions: question_id, tenant_id, content (and collection). chunks: the chunk table. cache: of embeddings; what it
    has is not asked from the provider.

    Every stage is keyed by question_id; the stages' frames are returned for inspection and cost nothing unread."""
    started, took = time.monotonic(), {}

    def tick(stage: str) -> None:
        nonlocal started
        now = time.monotonic()
        took[stage] = round((now - started) * 1000, 3)
        started = now

    chunks = search.in_state(chunks, valid_at=valid_at)
    space = provider.space.fingerprint
    chunks = chunks.where(F.col("embedding_space_fingerprint") == space)
    scope = [c for c in ("tenant_id", "collection") if c in questions.columns]
    asked = questions.select("question_id", *scope, "content")
    queries = fuse.rewrite_queries(asked, most=config.rewrite_queries, heuristic=config.heuristic_rewriter)
    if cache is None:
        vectors = embedded(queries, provider, text_col="query", out="query_embedding", batch=config.batch_size, concurrency=config.concurrency)
    else:
        vectors, new = embedded_once(queries, provider, cache.rows(), text_col="query", out="query_embedding", batch=config.batch_size, concurrency=config.concurrency)
        cache.add(new)
    tick("embedding")
    by_vector = search.vector_search(chunks, vectors, limit=config.candidate_limit, metric=config.metric, maximum_distance=config.maximum_distance, keys=["question_id", "query_no", "query"])
    far = by_vector if config.maximum_distance is None else search.vector_search(chunks, vectors, limit=config.candidate_limit, metric=config.metric, keys=["question_id", "query_no", "query"])
    rankings = by_vector.select("question_id", F.lit("vector").alias("ranking"), "query_no", "query", "rank", "chunk_id", "distance", F.lit(None).cast("double").alias("lexical_score"))
    if config.hybrid and config.lexical_weight > 0:
        lexical = lexical_ranking(chunks.dropDuplicates(["tenant_id", "collection", "chunk_id"]), asked, config)
        rankings = rankings.unionByName(lexical.select("question_id", F.lit(fuse.LEXICAL).alias("ranking"), F.lit(config.rewrite_queries).alias("query_no"), F.lit(fuse.LEXICAL).alias("query"), "rank", "chunk_id", "distance", "lexical_score"))
    weights = {"vector": config.vector_weight if config.hybrid else 1.0, fuse.LEXICAL: config.lexical_weight}
    tick("search")
    fused = fuse.fuse(rankings, limit=config.fused_limit or config.candidate_limit, weights=weights, constant=config.fusion_constant)
    body = [c for c in chunks.columns if c not in ("embedding", "metadata")]
    texts = asked.withColumnRenamed("content", "question")
    # few fused rows meet the chunk table: they are the side to broadcast, once counted
    fused = written(fused, "fused")
    tick("fusion")
    wide = chunks.select(*body).dropDuplicates(["tenant_id", "collection", "chunk_id"]).join(small(fused.join(texts, "question_id")), [*scope, "chunk_id"])
    stages = {"queries": queries, "rankings": rankings, "within_reach": by_vector, "nearest": far, "fused": fused}
    if config.rerank:
        wide = fuse.rerank_with(wide, reranker, candidate_limit=config.reranker_candidate_limit) if reranker else fuse.rerank(wide, candidate_limit=config.reranker_candidate_limit)
        stages["reranked"] = wide
    if config.adaptive:
        wide = select.adaptive_select(wide, relevance or config.relevance())
        stages["adaptive"] = wide
        wide = wide.where("selected")
    if config.abstain:
        wide = select.abstain(wide)
        stages["abstention"] = wide
        wide = wide.where("abstain_reason is null")
    wide = wide.withColumn("neighbor", F.lit(False))
    if config.neighbors_before or config.neighbors_after:
        wide = select.expand_neighbors(wide, chunks, before=config.neighbors_before, after=config.neighbors_after)
    stages["expanded"] = wide
    decided = select.budget(wide, limit=config.limit, maximum_characters=config.maximum_characters)
    stages["budget"] = decided
    results = decided.where("budget_reason is null").drop("budget_reason")
    tick("selection")
    return Outcome(results, diagnostics(questions, stages, config, reranker, took), stages)


def diagnostics(questions: DataFrame, stages: dict[str, DataFrame], config: Config = Config(), reranker=None, took: dict[str, float] | None = None) -> DataFrame:
    """One row a question: its queries; hits and results a query; how many the distance limit removed and how many hits
    were the same chunk; ids at every stage; who reranked, how many, and whether it failed or timed out; what was
    discarded and why; abstention, its reason and signals; and how long planning and running each stage took."""
    out = questions.select("question_id", F.col("content").alias("original_question"))

    def add(rows: DataFrame) -> None:
        nonlocal out
        out = out.join(rows, "question_id", "left")

    ids = lambda: F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"])
    add(stages["queries"].groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("query_no", "query")))["query"].alias("queries")))
    hits = stages["rankings"].groupBy("question_id", "query").agg(F.count("*").cast("int").alias("n"))
    add(hits.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("query", "n"))).alias("hits_by_query"), F.sum("n").alias("hits")))
    per_query = stages["rankings"].groupBy("question_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "distance"))).alias("found"))
    add(per_query.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("query", "found"))).alias("results_by_query")))
    add(stages["rankings"].groupBy("question_id").agg((F.count("*") - F.count_distinct("chunk_id")).alias("deduplicated")))
    if config.maximum_distance is not None:
        add(stages["nearest"].groupBy("question_id").agg(F.count_if(F.col("distance") > config.maximum_distance).alias("removed_by_distance")))
    add(stages["fused"].groupBy("question_id").agg(ids().alias("fused_ids"), F.count("*").alias("fused")))
    if "reranked" in stages:
        by_model = "rerank_error" in stages["reranked"].columns
        told = [F.max("rerank_error").alias("rerank_error"), F.max("rerank_timed_out").alias("rerank_timed_out")] if by_model else []
        out = out.withColumns({"reranker_provider": F.lit(getattr(reranker, "provider", "textual" if reranker is None else type(reranker).__name__)), "reranker_model": F.lit(getattr(reranker, "model", None)).cast("string")})
        add(stages["reranked"].groupBy("question_id").agg(ids().alias("reranked_ids"), F.count("*").alias("rerank_candidates"), F.max("rerank_failed").alias("rerank_failed"), *told, F.sum((F.col("rank") != F.col("rank_before")).cast("int")).alias("moved_by_reranker")))
    if "adaptive" in stages:
        add(stages["adaptive"].groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "reason"))).alias("adaptive_reasons")))
    if "abstention" in stages:
        add(select.abstentions(questions, stages["abstention"]).withColumnRenamed("reason", "abstention"))
        signals = stages["abstention"].groupBy("question_id").agg(F.max("candidate_count").alias("candidate_count"), F.max("lexically_supported").alias("lexically_supported"), F.filter(F.collect_list(F.when(F.col("abstain_reason").isNotNull(), F.col("chunk_id"))), lambda c: c.isNotNull()).alias("abstention_discarded"))
        add(signals)
    neighbor = F.coalesce("neighbor", F.lit(False))
    add(stages["expanded"].groupBy("question_id").agg(ids().alias("expanded_ids"), F.sort_array(F.collect_list(F.when(neighbor, F.col("chunk_id")))).alias("neighbor_ids")))
    discarded = F.map_from_entries(F.filter(F.collect_list(F.struct("chunk_id", "budget_reason")), lambda r: r["budget_reason"].isNotNull()))
    add(stages["budget"].groupBy("question_id").agg(discarded.alias("discarded"), F.sum(F.when(F.col("budget_reason").isNull(), F.length("content")).otherwise(0)).alias("characters"), F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "budget_reason"))), lambda r: r["budget_reason"].isNull()), lambda r: r["chunk_id"]).alias("selected_ids")))
    if "adaptive" in stages:
        # a chunk that was selected and then went for want of room has the later reason
        known, later = (F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in ("adaptive_reasons", "discarded"))
        out = out.withColumn("decisions", F.map_concat(F.map_filter(known, lambda k, _: ~F.map_contains_key(later, k)), later))
    else:
        out = out.withColumn("decisions", F.col("discarded"))
    if took:
        out = out.withColumn("milliseconds", F.create_map(*[x for k, v in took.items() for x in (F.lit(k), F.lit(v))]))
    return out
