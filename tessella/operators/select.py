"""From ranked chunks to context: adaptive selection, abstention, neighbours, budget. At most 100 rows a question."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.sizes import small
from tessella.functions.text import adaptive_terms, contains_any_case, named_terms
from tessella.operators.fuse import LEXICAL

REDUNDANT = 0.85
MOST_NEIGHBOURS = 20


@dataclass(frozen=True)
class RelevancePolicy:
    maximum_distance_gap: float = 0.08
    minimum_sources: int = 1
    maximum_sources: int = 5
    prefer_same_document: bool = True

    def __post_init__(self):
        if self.maximum_distance_gap < 0 or not 1 <= self.minimum_sources <= self.maximum_sources:
            raise ValueError("the gap can't be negative; 1 <= minimum_sources <= maximum_sources")


def choose(asked: set[str], candidates: list[dict], policy: RelevancePolicy) -> list[str]:
    """A reason for each candidate (id, document, distance, neighbor, terms), in ranking order; see SELECTED for those that mean yes."""
    first = next((i for i, c in enumerate(candidates) if not c["neighbor"]), 0)
    lead = candidates[first]
    reason = {first: "primary_evidence"}
    chosen = [set(lead["terms"])]
    open_terms = asked - chosen[0]
    near = lambda i: candidates[i]["document_id"] == lead["document_id"]
    order = range(len(candidates))
    if policy.prefer_same_document:
        order = sorted(order, key=lambda i: not near(i))
    ids = {lead["chunk_id"]}
    for i in order:
        c, terms = candidates[i], set(candidates[i]["terms"])
        if c["chunk_id"] in ids:
            reason.setdefault(i, reason[first])
            continue
        needed = len(ids) < policy.minimum_sources
        adds = open_terms & terms
        if len(ids) >= policy.maximum_sources:
            reason[i] = "source_limit"
        elif not needed and any(len(terms & old) >= REDUNDANT * len(terms | old) > 0 for old in chosen):
            reason[i] = "duplicate_evidence"
        elif adds or needed:
            if c["neighbor"] and near(i):
                reason[i] = "neighbor_context"
            else:
                reason[i] = "same_document_support" if near(i) and policy.prefer_same_document else "additional_coverage"
            ids.add(c["chunk_id"])
            chosen.append(terms)
            open_terms -= adds
        else:
            reason[i] = "distance_gap" if c["distance"] - lead["distance"] > policy.maximum_distance_gap else "duplicate_evidence"
    return [reason[i] for i in range(len(candidates))]


SELECTED = ("primary_evidence", "same_document_support", "additional_coverage", "neighbor_context")


def adaptive_select(rows: DataFrame, policy: RelevancePolicy = RelevancePolicy()) -> DataFrame:
    """rows (question_id, question, rank, chunk_id, document_id, distance, content[, neighbor]) with selected and reason."""

    @F.pandas_udf("array<string>")
    def decide(asked: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([choose(set(a), list(c), policy) for a, c in zip(asked, lists)])

    neighbor = F.coalesce("neighbor", F.lit(False)) if "neighbor" in rows.columns else F.lit(False)
    one = F.struct("rank", "chunk_id", "document_id", "distance", neighbor.alias("neighbor"), adaptive_terms(F.col("content")).alias("terms"))
    lists = rows.groupBy("question_id").agg(adaptive_terms(F.first("question")).alias("asked"), F.array_sort(F.collect_list(one)).alias("c"))
    told = lists.select("question_id", F.explode(F.arrays_zip(F.col("c.rank").alias("rank"), decide("asked", "c").alias("reason"))).alias("d")).select("question_id", "d.rank", "d.reason")
    return rows.join(told, ["question_id", "rank"]).withColumn("selected", F.col("reason").isin(*SELECTED))


def abstain(rows: DataFrame) -> DataFrame:
    """rows (question_id, question, chunk_id, content, lexical_score, matches) with abstain_reason and signals; rejected where it is not null.

    A question is rejected if its only hit has no lexical support and names it is about do not occur in the hit."""
    whole = Window.partitionBy("question_id")
    lexical = F.col("lexical_score").isNotNull()
    if "matches" in rows.columns:
        lexical = lexical | F.exists("matches", lambda m: m["ranking"] == LEXICAL)
    counted = rows.withColumns({"candidate_count": F.count("*").over(whole), "lexically_supported": F.sum(lexical.cast("int")).over(whole), "named": named_terms(F.col("question"))})
    met = F.exists("named", lambda t: contains_any_case(F.col("content"), t))
    weak = (F.col("candidate_count") == 1) & (F.col("lexically_supported") == 0) & (F.size("named") > 0) & ~met
    return counted.withColumn("abstain_reason", F.when(weak, "isolated_vector_hit_without_named_term")).drop("named")


def abstentions(questions: DataFrame, decided: DataFrame) -> DataFrame:
    """(question_id, reason): no_candidates, the reason of a rejection, or evidence_accepted."""
    per = decided.groupBy("question_id").agg(F.max("abstain_reason").alias("reason"), F.lit(True).alias("some"))
    reason = F.when(F.col("some").isNull(), "no_candidates").otherwise(F.coalesce("reason", F.lit("evidence_accepted")))
    return questions.select("question_id").join(per, "question_id", "left").select("question_id", reason.alias("reason"))


def expand_neighbors(hits: DataFrame, chunks: DataFrame, *, before: int = 1, after: int = 1, keys: tuple[str, ...] = ("tenant_id", "collection", "status", "document_id", "document_version", "embedding_space_fingerprint")) -> DataFrame:
    """hits (question_id, rank, chunk_id, document_id, position, ...) and the chunks around them, each chunk once a question.

    Order: the rank of the hit that brings a chunk, then position. A chunk that is a hit itself stays a hit; a neighbour has
    the scores of its hit and neighbor = true. Hits without a document version bring no neighbours."""
    if not (0 <= before <= MOST_NEIGHBOURS and 0 <= after <= MOST_NEIGHBOURS):
        raise ValueError(f"from 0 to {MOST_NEIGHBOURS} neighbours on a side")
    keys = [k for k in keys if k in hits.columns and k in chunks.columns]
    span = F.sequence(F.greatest(F.lit(0), F.col("position") - before), F.col("position") + after)
    wanted = hits.select("question_id", "rank", F.col("position").alias("hit_position"), *keys, F.explode(span).alias("position")).where("position <> hit_position")
    other = chunks.select(*keys, "position", F.col("chunk_id"), "content")
    # equality on position too: a hash join on the document's key instead of a range join
    found = other.join(small(wanted), [*keys, "position"])
    found = found.join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
    scores = [c for c in hits.columns if c not in {*found.columns, "neighbor"}]
    near = found.join(hits.select("question_id", "rank", *scores), ["question_id", "rank"]).withColumn("neighbor", F.lit(True))
    every = hits.withColumn("neighbor", F.lit(False)).unionByName(near.select(*hits.drop("neighbor").columns, "neighbor"))
    first = Window.partitionBy("question_id", "chunk_id").orderBy("neighbor", "rank")
    order = Window.partitionBy("question_id").orderBy("hit_rank", "position", "chunk_id")
    once = every.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").withColumnRenamed("rank", "hit_rank")
    return once.withColumn("rank", F.row_number().over(order))


def budget(rows: DataFrame, *, limit: int, maximum_characters: int | None = None) -> DataFrame:
    """rows (question_id, rank, content, ...) with budget_reason: null if kept, source_limit, or context_budget.

    A chunk that is too long is passed over; a shorter one behind it may still fit. So kept rows depend on kept rows
    before them, and a fold over each question's lengths decides; no running sum could."""
    if limit < 1 or (maximum_characters is not None and maximum_characters < 1):
        raise ValueError("limits must be positive")
    sized = rows.withColumn("__n", F.length("content"))
    lists = sized.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("__n").alias("n")))).alias("c"))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,reason:string>>").alias("told"))
    most = F.lit(maximum_characters).cast("long")

    def step(a, c):
        full = a["kept"] >= limit
        over = F.coalesce(a["used"] + c["n"] > most, F.lit(False))
        fits = ~full & ~over
        reason = F.when(full, "source_limit").when(over, "context_budget")
        return F.struct(
            (a["kept"] + fits.cast("int")).alias("kept"),
            (a["used"] + F.when(fits, c["n"]).otherwise(0)).cast("long").alias("used"),
            F.concat(a["told"], F.array(F.struct(c["rank"].alias("rank"), reason.alias("reason")))).alias("told"),
        )

    told = lists.select("question_id", F.explode(F.aggregate("c", start, step)["told"]).alias("t")).select("question_id", "t.rank", F.col("t.reason").alias("budget_reason"))
    return sized.drop("__n").join(told, ["question_id", "rank"])
