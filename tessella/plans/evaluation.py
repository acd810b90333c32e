"""Golden cases through the engine: all cases are one batch of questions, scored together."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import evaluate
from tessella.plans.engine import Engine
from tessella.plans.rag import answer
from tessella.sources.scratch import written


class Evaluation(NamedTuple):
    scores: DataFrame  # case_id, metric, value, passed
    statuses: DataFrame  # case_id, status
    report: DataFrame  # metric, cases, average, passed
    milliseconds: dict[str, float]  # how long searching and answering all cases took, and that for a case


def _questions(engine: Engine, cases: DataFrame) -> DataFrame:
    tenant = F.coalesce(F.col("tenantId"), F.lit(engine.config.tenant))
    return cases.select(F.col("id").alias("question_id"), tenant.alias("tenant_id"), F.lit(engine.config.collection).alias("collection"), F.col("question").alias("content"))


def _of(cases: DataFrame, column: str, name: str) -> DataFrame:
    return cases.select(F.col("id").alias("case_id"), F.explode(column).alias(name))


def retrieval_scores(cases: DataFrame, results: DataFrame) -> DataFrame:
    """results: question_id, rank, chunk_id, document_id, content."""
    found = results.withColumnRenamed("question_id", "case_id")
    keyed = cases.withColumnsRenamed({"id": "case_id"})
    by_chunk = evaluate.rank_metrics(found, _of(cases, "relevantChunkIds", "chunk_id"))
    by_document = evaluate.rank_metrics(found, _of(cases, "relevantDocumentIds", "document_id"), item="document_id", prefix="document")
    none = evaluate.no_evidence_metric(keyed.select("case_id", F.coalesce("expectNoEvidence", F.lit(False)).alias("expect_no_evidence")), found)
    evidence = cases.select(F.col("id").alias("case_id"), F.posexplode("relevantEvidence").alias("evidence_no", "e")).select("case_id", "evidence_no", F.col("e.documentId").alias("document_id"), F.col("e.requiredTextGroups").alias("groups"))
    return by_chunk.union(by_document).union(none).union(evaluate.evidence_recall(evidence, found.select("case_id", "document_id", "content")))


def answer_scores(cases: DataFrame, answers: DataFrame, results: DataFrame, *, language: str = "pt", policy: evaluate.PassPolicy = evaluate.PassPolicy()) -> DataFrame:
    """answers: question_id, answer. Cases without evidence have no answer scores."""
    told = cases.where(~F.coalesce("expectNoEvidence", F.lit(False))).join(answers.select(F.col("question_id").alias("id"), "answer"), "id")
    singles = F.transform(F.coalesce("expectedTerms", F.array().cast("array<string>")), lambda t: F.array(t))
    groups = F.concat(F.coalesce("expectedTermGroups", F.array().cast("array<array<string>>")), singles)
    claims = F.transform("expectedClaims", lambda c: c["alternatives"])
    strict, normal = evaluate.exact_match(F.col("answer"), F.col("expectedAnswer"))
    rows = told.select(
        F.col("id").alias("case_id"),
        evaluate.terms_score(F.col("answer"), groups).alias("expected_terms"),
        evaluate.correctness(F.col("answer"), claims, F.col("expectedAnswer")).alias("correctness"),
        evaluate.relevance(F.col("question"), F.col("answer")).alias("answer_relevance"),
        strict.cast("double").alias("exact_match"),
        normal.cast("double").alias("normalized_match"),
    )
    least = {"expected_terms": 1.0, "correctness": policy.correctness, "answer_relevance": policy.answer_relevance}
    decides = evaluate._long(rows, {m: (F.col(m), F.col(m) >= v) for m, v in least.items()})
    sources = results.select(F.col("question_id").alias("case_id"), F.col("rank").alias("source_rank"), "chunk_id", "content")
    grounded = evaluate.groundedness(told.select(F.col("id").alias("case_id"), "answer"), sources, language=language, passing=policy.groundedness)
    return decides.union(grounded)


def evaluate_engine(engine: Engine, cases: DataFrame, *, answers: bool = True, language: str = "pt", policy: evaluate.PassPolicy = evaluate.PassPolicy()) -> Evaluation:
    """Search, and ask, all cases; a case whose model fails has status error and no answer scores."""
    asked = _questions(engine, cases)
    # every metric reads the results: they are computed once
    began = time.monotonic()
    results = written(engine.search(asked).results, "evaluation-results")
    took = {"search": (time.monotonic() - began) * 1000}
    scores, errors = retrieval_scores(cases, results), None
    if answers:
        began = time.monotonic()
        told = written(answer(asked, results, engine.model).answers, "evaluation-answers")
        took["answer"] = (time.monotonic() - began) * 1000
        scores = scores.union(answer_scores(cases, told.where("error is null"), results, language=language, policy=policy))
        errors = told.where("error is not null").select(F.col("question_id").alias("case_id"))
    scores = written(scores, "evaluation-scores")
    statuses = evaluate.case_status(cases.select(F.col("id").alias("case_id")), scores, errors, policy)
    took["a_case"] = sum(took.values()) / max(1, cases.count())
    return Evaluation(scores, statuses, evaluate.report(scores), {k: round(v, 3) for k, v in took.items()})
