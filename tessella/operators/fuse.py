"""Rankings: query rewriting, weighted reciprocal rank fusion, reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import ProviderError, RerankerError
from tessella.functions.text import comparable, let, rerank_terms
from tessella.operators.embed import check_url, post_json

LEXICAL = "__lexical__"
CONSTANT = 60
MAX_QUERIES = 4
# Code in backticks, words joined by - or _, capitals, a letter with a bracket; and names.
TECHNICAL = r"(?U)`[^`]+`|(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*(?:[_-][\p{L}\p{N}]+)+|\b[A-Z][A-Z0-9_-]{2,}\b|[a-zA-Z]\[[^\]\r\n]{1,24}\]"
PROPER = r"(?U)\b[A-Z][a-z]{3,}\b"


def rewritten(question: Column, most: int = MAX_QUERIES) -> Column:
    """The queries for a question: itself, its terms as far as there is room, and all of them as one if there is still room.

    Terms are the technical ones, then the names that stand in no technical term or earlier name. Of several names, or
    beside technical terms, the first is as a rule the capital of the sentence and is left out."""
    inside = lambda word, words: F.exists(words, lambda w: F.contains(F.lower(w), F.lower(word)))

    def queries(found: Column) -> Column:
        technical, names = found["technical"], found["names"]
        own = F.filter(names, lambda n, i: ~inside(n, F.concat(technical, F.when(i > 0, F.slice(names, 1, F.greatest(i, F.lit(1)))).otherwise(_none()))))
        return let(F.concat(technical, own), lambda terms: F.array_distinct(F.concat(F.array(question), F.slice(terms, 1, max(most - 1, 1)), joined(terms))))

    def joined(terms: Column) -> Column:
        return F.when((F.size(terms) > 1) & (F.size(terms) + 1 < most), F.array(F.array_join(terms, " "))).otherwise(_none())

    technical = F.transform(F.regexp_extract_all(question, F.lit(TECHNICAL), F.lit(0)), lambda t: F.trim(F.btrim(t, F.lit("`"))))
    technical = F.array_distinct(F.filter(technical, lambda t: (t != "") & (F.lower(t) != F.lower(question))))
    names = F.array_distinct(F.regexp_extract_all(question, F.lit(PROPER), F.lit(0)))
    later = lambda f: F.when((F.size(f["names"]) > 1) | (F.size(f["technical"]) > 0), F.slice(f["names"], 2, F.greatest(F.size(f["names"]), F.lit(1)))).otherwise(f["names"])
    return let(F.struct(technical.alias("technical"), names.alias("names")), lambda f: let(F.struct(f["technical"].alias("technical"), later(f).alias("names")), queries))


def _none() -> Column:
    return F.array().cast("array<string>")


def rewrite_queries(questions: DataFrame, *, most: int = MAX_QUERIES, heuristic: bool = True) -> DataFrame:
    """One row a query: question_id, query_no (0 is the question itself), query, and the question's other columns."""
    if not 1 <= most <= 10:
        raise ValueError("from one to ten queries")
    queries = rewritten(F.col("content"), most) if heuristic else F.array("content")
    return questions.select("*", F.posexplode(queries).alias("query_no", "query"))


def check_weights(weights: Mapping[str, float]) -> None:
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")


def fuse(rankings: DataFrame, *, limit: int, weights: Mapping[str, float] | None = None, constant: int = CONSTANT, carry: list[str] | None = None) -> DataFrame:
    """One row a question and chunk: fusion_score, distance (least), lexical_score (most), matches, rank.

    rankings: question_id, ranking, rank, chunk_id, distance, lexical_score, query_no, query. weights: by ranking, 1 if not given;
    rankings of weight zero are left out. Order: score, distance, chunk id."""
    weights = weights or {}
    check_weights(weights)
    weight: Column = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("ranking") == name, F.lit(float(w))).otherwise(weight)
    rows = rankings.withColumn("weight", weight).where(F.col("weight") > 0)
    match = F.struct("query_no", "ranking", "query", "rank", "distance")
    fused = rows.groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("weight") / (constant + F.col("rank"))).alias("fusion_score"),
        F.min("distance").alias("distance"),
        F.max("lexical_score").alias("lexical_score"),
        F.array_sort(F.collect_list(match)).alias("matches"),
        *[F.first(c).alias(c) for c in carry or []],
    )
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("fusion_score", 12)), "distance", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def textual_score(question: Column, content: Column) -> Column:
    def part(terms: Column, text: Column) -> Column:
        found = F.size(F.filter(terms, lambda t: F.contains(text, t)))
        return F.when(F.size(terms) == 0, 0.0).otherwise(found / F.size(terms))

    return let(rerank_terms(question), lambda terms: let(comparable(content), lambda text: part(terms, text)))


def rerank(rows: DataFrame, score: Column | None = None, *, candidate_limit: int | None = None) -> DataFrame:
    """rows (question_id, rank, question, content, ...) with reranker_score, rank_before and a new rank.

    Of candidates behind candidate_limit none are kept. A null score is a failed reranker: the question keeps its order."""
    if candidate_limit is not None:
        rows = rows.where(F.col("rank") <= candidate_limit)
    scored = rows.withColumn("reranker_score", textual_score(F.col("question"), F.col("content")) if score is None else score).withColumnRenamed("rank", "rank_before")
    whole = Window.partitionBy("question_id")
    failed = F.max(F.col("reranker_score").isNull()).over(whole)
    order = whole.orderBy(F.desc(F.when(~F.col("rerank_failed"), F.col("reranker_score"))), "rank_before")
    return scored.withColumn("rerank_failed", failed).withColumn("rank", F.row_number().over(order))


def rerank_with(rows: DataFrame, model: Callable[[str, list[str]], list[float]], *, candidate_limit: int | None = None) -> DataFrame:
    """Rerank by a model that scores one question's contents, all at once; scores outside [0, 1] or a raised error keep the
    order, and rerank_error and rerank_timed_out tell why."""
    if candidate_limit is not None:
        rows = rows.where(F.col("rank") <= candidate_limit)

    @F.pandas_udf("scores array<double>, error string, timed_out boolean")
    def run(questions: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for q, texts in zip(questions, contents):
            try:
                out.append((checked_scores(list(model(q, list(texts))), len(texts)), None, False))
            except Exception as e:  # whatever a foreign model raises must not lose the question
                out.append(([None] * len(texts), f"{type(e).__name__}: {e}", timed_out(e)))
        return pd.DataFrame(out, columns=["scores", "error", "timed_out"])

    # at most candidate_limit rows a question
    lists = rows.groupBy("question_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("c"))
    told = lists.select("question_id", "c.chunk_id", run("question", F.col("c.content")).alias("r"))
    scores = told.select("question_id", F.explode(F.arrays_zip(F.col("chunk_id"), F.col("r.scores").alias("score"))).alias("s"), F.col("r.error").alias("rerank_error"), F.col("r.timed_out").alias("rerank_timed_out"))
    scores = scores.select("question_id", "s.chunk_id", F.col("s.score").alias("__score"), "rerank_error", "rerank_timed_out")
    return rerank(rows.join(scores, ["question_id", "chunk_id"]), F.col("__score")).drop("__score")


def checked_scores(scores: list, n: int) -> list[float]:
    if len(scores) != n:
        raise RerankerError("the ranking is incomplete")
    if not all(isinstance(s, (int, float)) and math.isfinite(s) and 0 <= s <= 1 for s in scores):
        raise RerankerError("a score is not from 0 to 1")
    return scores


def timed_out(error: BaseException | None) -> bool:
    """Whether a timeout is behind an error."""
    while error is not None:
        if isinstance(error, TimeoutError) or getattr(error, "timed_out", False):
            return True
        reason = getattr(error, "reason", None)
        error = reason if isinstance(reason, BaseException) else error.__cause__
    return False


@dataclass
class HttpReranker:
    """An address /rerank that takes {model, query, documents, top_n} and gives every document's index and relevance_score."""

    provider: str
    model: str
    base_url: str
    key: str | None = None
    timeout: float = 30
    post: Callable = post_json

    def __call__(self, question: str, contents: list[str]) -> list[float]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        try:
            reply = self.post(f"{check_url(self.base_url)}/rerank", {"model": self.model, "query": question, "documents": contents, "top_n": len(contents)}, headers, self.timeout)
        except ProviderError as e:
            raise RerankerError("the reranker's request failed", timed_out(e)) from e
        rows = reply.get("results")
        if not isinstance(rows, list) or len(rows) != len(contents):
            raise RerankerError("the ranking is incomplete")
        scores: dict[int, float] = {}
        for row in rows:
            index = row.get("index") if isinstance(row, dict) else None
            if type(index) is not int or not 0 <= index < len(contents) or index in scores:
                raise RerankerError("an index is missing, repeated or unknown")
            scores[index] = row.get("relevance_score")
        return checked_scores([scores[i] for i in range(len(contents))], len(contents))


def is_permutation(before: DataFrame, after: DataFrame) -> bool:
    """Whether a reranking lost or made up no row."""
    keys = ["question_id", "chunk_id"]
    a, b = (df.groupBy(*keys).count() for df in (before, after))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
