"""Evaluation of retrieval and answers against golden cases, all cases at once.

Scores are rows (case_id, metric, value, passed); a metric that does not apply to a case has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import claims, comparable, is_negated, let, protected_terms, sentences, significant_terms, trimmed
from tessella.operators.nearest import tasks_for

COVERAGE, EXCERPT = 0.6, 240


def first_seen(retrieved: DataFrame, item: str) -> DataFrame:
    """(case_id, item, rank): each item once, ranked by where it first occurs."""
    once = retrieved.groupBy("case_id", item).agg(F.min("rank").alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("at"))).drop("at")


def rank_metrics(retrieved: DataFrame, expected: DataFrame, *, item: str = "chunk_id", prefix: str = "chunk") -> DataFrame:
    """Recall, precision, reciprocal rank, hit rate and hit at 1 of every case that expects items.

    retrieved: case_id, item, rank. expected: case_id, item."""
    want = expected.select("case_id", item).distinct()
    seen = first_seen(retrieved, item)
    n_seen = seen.groupBy("case_id").agg(F.count("*").alias("n_seen"))
    hit = want.join(seen, ["case_id", item], "left").groupBy("case_id").agg(F.count("*").alias("n_want"), F.count("rank").alias("n_hit"), F.min("rank").alias("first"))
    return _rank_values(hit.join(n_seen, "case_id", "left"), prefix)


def rank_metrics_of_groups(retrieved: DataFrame, cases: DataFrame, members: DataFrame, *, item: str = "chunk_id", prefix: str = "chunk", own: str | None = None) -> DataFrame:
    """rank_metrics() of cases that expect all items of one group each, without a row for every case and item of its group.

    retrieved: case_id, item, rank. cases: case_id, group. members: group, item.
    own: retrieved also has the case's group and, under this name, the item's, so that it meets neither cases nor members by
    join. members must then hold every item once (see each_once) and every case must have retrieved something."""
    if own is not None:
        return _rank_values(_hits_by_own_group(retrieved, members, item, own), prefix)
    asked, held = cases.select("case_id", "group").distinct(), members.select("group", item).distinct()
    n_want = held.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n_want"))
    met = first_seen(retrieved, item).join(asked, "case_id").join(held.withColumn("wanted", F.lit(True)), ["group", item], "left")
    per = met.groupBy("case_id").agg(F.count("*").alias("n_seen"), F.count("wanted").alias("n_hit"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first"))
    hit = asked.join(n_want, "group").join(per, "case_id", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return _rank_values(hit, prefix)


def each_once(members: DataFrame, item: str) -> bool:
    """Whether every item is there once and none is null."""
    n, distinct = members.select(item).repartition(tasks_for(members), item).agg(F.count("*"), F.count_distinct(item)).first()
    return n == distinct


def _hits_by_own_group(retrieved: DataFrame, members: DataFrame, item: str, own: str) -> DataFrame:
    """All by the key that retrieved was ranked by, so nothing is shuffled again."""
    case = ["case_id", "group"]
    known = retrieved.where(F.col("group").isNotNull()).withColumn("own", F.col(own))
    once = known.groupBy(*case, item).agg(F.min("rank").alias("at"), F.min("own").alias("own"))
    seen = once.withColumn("rank", F.row_number().over(Window.partitionBy(*case).orderBy("at")))
    wanted = F.col("own") == F.col("group")
    per = seen.groupBy(*case).agg(F.count("*").alias("n_seen"), F.count_if(wanted).alias("n_hit"), F.min(F.when(wanted, F.col("rank"))).alias("first"))
    return per.join(members.groupBy("group").agg(F.count("*").alias("n_want")), "group")


def _rank_values(hit: DataFrame, prefix: str) -> DataFrame:
    """hit: case_id, n_want, n_hit, first, n_seen (null: none)."""
    rows = hit.withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    some = F.col("n_hit") > 0
    values = {
        "recall": (F.col("n_hit") / F.col("n_want"), F.col("n_hit") == F.col("n_want")),
        "precision": (F.when(F.col("n_seen") == 0, 0.0).otherwise(F.col("n_hit") / F.col("n_seen")), some),
        "mrr": (F.coalesce(1 / F.col("first"), F.lit(0.0)), some),
        "hit_rate": (some.cast("double"), some),
        "hit_at_1": ((F.coalesce("first", F.lit(0)) == 1).cast("double"), F.coalesce("first", F.lit(0)) == 1),
    }
    return _long(rows, {f"{prefix}_{k}": v for k, v in values.items()})


def _long(rows: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), p.alias("passed")) for k, (v, p) in values.items()])
    return rows.select("case_id", F.explode(each).alias("s")).select("case_id", "s.metric", "s.value", "s.passed").where(F.col("value").isNotNull())


def no_evidence_metric(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """1 for cases without evidence for which nothing was retrieved, else 0."""
    n = retrieved.groupBy("case_id").agg(F.count("*").alias("n"))
    none = cases.where("expect_no_evidence").select("case_id").join(n, "case_id", "left").withColumn("none", F.coalesce("n", F.lit(0)) == 0)
    return _long(none, {"no_evidence": (F.col("none").cast("double"), F.col("none"))})


def evidence_recall(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Of the evidence (case_id, evidence_no, document_id, groups) the part for which one source of that document
    (case_id, document_id, content) has an alternative of every group."""
    held = let(comparable(F.col("content")), lambda text: F.forall("groups", lambda g: F.exists(g, lambda t: F.contains(text, comparable(t)))))
    met = evidence.join(sources, ["case_id", "document_id"], "left").withColumn("met", F.coalesce(held, F.lit(False)))
    per = met.groupBy("case_id", "evidence_no").agg(F.max("met").alias("met")).groupBy("case_id").agg(F.avg(F.col("met").cast("double")).alias("v"))
    return _long(per, {"evidence_recall": (F.col("v"), F.col("v") == 1)})


def exact_match(answer: Column, expected: Column) -> tuple[Column, Column]:
    """(strict, normalised)"""
    return answer == expected, comparable(answer) == comparable(expected)


def _part_met(answer: Column, groups: Column) -> Column:
    met = lambda text: F.size(F.filter(groups, lambda g: F.exists(g, lambda t: F.contains(text, comparable(t)))))
    return let(comparable(answer), met) / F.size(groups)


def terms_score(answer: Column, groups: Column) -> Column:
    """Part of the groups of which an alternative is in the answer; null without groups."""
    return F.when(F.size(groups) > 0, _part_met(answer, groups))


def correctness(answer: Column, claims_: Column, expected: Column) -> Column:
    """Part of the expected claims (arrays of alternatives) found; else whether the expected answer is found; else null."""
    whole = F.contains(comparable(answer), comparable(expected)).cast("double")
    return F.when(F.coalesce(F.size(claims_), F.lit(0)) > 0, _part_met(answer, claims_)).when(expected.isNotNull(), whole)


def relevance(question: Column, answer: Column) -> Column:
    """Part of the question's significant terms that the answer has; null if it has none."""

    def part(terms: Column, text: Column) -> Column:
        return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms))

    return let(significant_terms(question), lambda terms: let(comparable(answer), lambda text: part(terms, text)))


def supported_claims(answers: DataFrame, sources: DataFrame, language: str = "pt") -> DataFrame:
    """(case_id, claim_no, claim, chunk_id, evidence): every claim, with the first source that supports it or nulls.

    answers: case_id, answer. sources: case_id, source_rank, chunk_id, content. A source supports a claim if both or
    neither are negated and it has the claim word for word, or all its protected and enough of its significant terms."""
    parts = answers.select("case_id", F.posexplode(claims(F.col("answer"), language)).alias("claim_no", "claim"))
    said = parts.withColumns({"c": comparable(F.col("claim")), "terms": significant_terms(F.col("claim")), "fixed": protected_terms(F.col("claim"))})
    text = sources.withColumn("t", comparable(F.col("content")))
    pairs = said.join(text, "case_id")
    has = lambda w: F.contains(F.col("t"), w)
    whole = has(F.col("c"))
    covered = (F.size("terms") > 0) & (F.size(F.filter("terms", has)) >= COVERAGE * F.size("terms"))
    good = (is_negated(F.col("c"), language) == is_negated(F.col("t"), language)) & (whole | (F.forall("fixed", has) & covered))
    with_part = F.when(whole, F.col("claim")).otherwise(F.coalesce(trimmed(F.try_element_at(F.filter(sentences(F.col("content")), lambda s: F.exists("terms", lambda w: F.contains(comparable(s), w))), F.lit(1))), F.substring(trimmed(F.col("content")), 1, EXCERPT)))
    best = pairs.where(good).groupBy("case_id", "claim_no").agg(F.min_by(F.struct("chunk_id", with_part.alias("evidence")), "source_rank").alias("s"))
    return parts.join(best, ["case_id", "claim_no"], "left").select("case_id", "claim_no", "claim", "s.chunk_id", "s.evidence")


def groundedness(answers: DataFrame, sources: DataFrame, *, language: str = "pt", passing: float = 0.8) -> DataFrame:
    """Part of an answer's claims that its sources support; 0 without claims. Answers without sources have no score."""
    has = sources.select("case_id").distinct()
    told = supported_claims(answers.join(has, "case_id", "left_semi"), sources, language)
    per = has.join(answers.select("case_id"), "case_id", "left_semi").join(told.groupBy("case_id").agg(F.avg(F.col("chunk_id").isNotNull().cast("double")).alias("v")), "case_id", "left")
    value = F.coalesce("v", F.lit(0.0))
    return _long(per, {"groundedness": (value, value >= passing)})


def golden_match(chunks: DataFrame, cases: DataFrame, mode: str = "any") -> DataFrame:
    """(case_id, chunk_id) of chunks that hold any or all of a case's terms, in any case. cases: case_id, terms."""
    from tessella.functions.sizes import small

    if mode not in ("any", "all"):
        raise ValueError("mode is any or all")
    lowered = small(cases.select("case_id", F.transform("terms", F.lower).alias("terms")))
    text = F.col("__lower")
    met = (F.exists if mode == "any" else F.forall)("terms", lambda t: F.contains(text, t))
    return chunks.select("chunk_id", F.lower("content").alias("__lower")).join(lowered, met).select("case_id", "chunk_id")


@dataclass(frozen=True)
class PassPolicy:
    groundedness: float = 0.8
    answer_relevance: float = 0.8
    correctness: float = 0.8
    require_terms: bool = False


def case_status(cases: DataFrame, scores: DataFrame, errors: DataFrame | None = None, policy: PassPolicy = PassPolicy()) -> DataFrame:
    """(case_id, status): error, not_applicable without a score, else passed or failed. hit_at_1 never decides."""
    limits = {"groundedness": policy.groundedness, "answer_relevance": policy.answer_relevance, "correctness": policy.correctness}
    ok = F.col("passed")
    for name, least in limits.items():
        ok = F.when(F.col("metric") == name, F.col("value") >= least).otherwise(ok)
    counts = ~F.col("metric").endswith("_hit_at_1")
    if not policy.require_terms:
        counts = counts & (F.col("metric") != "expected_terms")
    per = scores.where(counts).groupBy("case_id").agg(F.min(ok).alias("ok"))
    rows = cases.select("case_id").join(per, "case_id", "left")
    status = F.when(F.col("ok").isNull(), "not_applicable").when(F.col("ok"), "passed").otherwise("failed")
    if errors is not None:
        rows = rows.join(errors.select("case_id", F.lit(True).alias("bad")).distinct(), "case_id", "left")
        status = F.when(F.col("bad"), "error").otherwise(status)
    return rows.select("case_id", status.alias("status"))


def report(scores: DataFrame) -> DataFrame:
    """(metric, cases, average, passed) over the cases to which each metric applies."""
    return scores.groupBy("metric").agg(F.count("*").alias("cases"), F.avg("value").alias("average"), F.sum(F.col("passed").cast("long")).alias("passed"))
