"""Registered queries on vector search: that they search once and make no row for every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate, search
from tessella.plans import catalog


def tables(spark, path, n=120):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_metrics_of_groups_are_those_of_their_items(spark):
    rng = random.Random(2)
    got = spark.createDataFrame([(c, i, n) for c in range(12) for n, i in enumerate(rng.sample(range(30), c % 5), 1)], "case_id long, chunk_id long, rank int")
    members = spark.createDataFrame([(i % 4 if i % 7 else None, i) for i in range(30)] + [(1, 1)], "group int, chunk_id long")
    cases = spark.createDataFrame([(c, c % 5 if c != 11 else None) for c in range(12)], "case_id long, group int")
    want = evaluate.rank_metrics(got, cases.join(members, "group"))
    found = evaluate.rank_metrics_of_groups(got, cases, members)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


@pytest.mark.parametrize("name", ["rank_metrics_chunk", "rank_metrics_document", "eval_report_avg"])
def test_metrics_make_no_row_for_every_expected_item(spark, tmp_path, monkeypatch, name):
    held = []
    real = evaluate.rank_metrics_of_groups
    monkeypatch.setattr(evaluate, "rank_metrics_of_groups", lambda got, cases, members, **how: held.append((cases.count(), members.count())) or real(got, cases, members, **how))
    assert catalog.QUERIES[name](spark, tables(spark, tmp_path)).count() > 0
    assert held == [(6, 120)]  # not 6 x 40 pairs


def test_neighbours_search_once(spark, tmp_path, monkeypatch):
    searched = []
    monkeypatch.setattr(search, "vector_search", lambda *a, real=search.vector_search, **how: searched.append(real(*a, **how)) or searched[-1])
    found = catalog.QUERIES["neighbor_expand"](spark, tables(spark, tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(searched) == 1 and "MapInArrow" not in plan and "hits-" in found._jdf.queryExecution().executedPlan().toString()
    assert found.where(~F.col("neighbor")).count() == 6 * 3


def test_fused_rankings_compare_blocks(spark, tmp_path):
    plan = catalog.QUERIES["rrf_weighted"](spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 4 and "lambda" not in plan  # two searches, two sides


def test_the_threshold_keeps_far_pairs_in_the_workers(spark, tmp_path):
    where = tables(spark, tmp_path)
    assert "MapInArrow" in catalog.QUERIES["vector_threshold"](spark, where)._jdf.queryExecution().optimizedPlan().toString()
    chunks = catalog.vector_chunks(spark, where)
    near = search.vector_search(chunks, catalog.vector_questions(chunks), limit=100, maximum_distance=0.7, keys=["question_id"]).collect()
    every = search.vector_search(chunks, catalog.vector_questions(chunks), limit=100, keys=["question_id"]).collect()
    assert sorted(map(tuple, near)) == sorted(tuple(r) for r in every if r["distance"] <= 0.7)


@pytest.mark.parametrize("name", ["rank_metrics_chunk", "eval_report_avg"])
def test_metrics_deal_vectors_out_by_their_number(spark, tmp_path, name):
    """Not to as many tasks as there are shuffle partitions, which took most of the time at 200."""
    where, before = tables(spark, tmp_path, 1400), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        plan = catalog.QUERIES[name](spark, where)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(re.findall(r"RepartitionByExpression \[chunk_id#\d+L?\], (\d+)", plan)) == {"6"}


def test_metrics_by_own_group_are_those_of_items(spark):
    rng = random.Random(4)
    group = {i: i % 4 if i % 7 else None for i in range(40)}
    members = spark.createDataFrame([(group[i], i) for i in group], "group int, chunk_id long")
    cases = spark.createDataFrame([(c, group[c]) for c in range(0, 40, 3)], "case_id long, group int")
    rows = [(c, group[c], i, group[i], n) for c in range(0, 40, 3) for n, i in enumerate(rng.sample(range(40), 1 + c % 5), 1)]
    got = spark.createDataFrame(rows, "case_id long, group int, chunk_id long, label int, rank int")
    want = evaluate.rank_metrics(got, cases.join(members, "group"))
    found = evaluate.rank_metrics_of_groups(got, cases, members, own="label")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_each_once(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "chunk_id long")
    assert evaluate.each_once(rows(1, 2, 3), "chunk_id") and evaluate.each_once(rows(), "chunk_id")
    assert not evaluate.each_once(rows(1, 2, 1), "chunk_id") and not evaluate.each_once(rows(1, None), "chunk_id")


@pytest.mark.parametrize("name", ["rank_metrics_chunk", "eval_report_avg"])
def test_metrics_join_no_vectors_behind_the_search(spark, tmp_path, name):
    """Before, hits met the cases and all vectors by join: six reads of the table."""
    plan = catalog.QUERIES[name](spark, tables(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3 and plan.count("Join") <= 2 and plan.count("Window [row_number()") == 2


@pytest.mark.parametrize("again", [[(7, 7 % 3)], [(7, 2), (9, 1)]])
def test_metrics_of_vectors_that_are_there_twice(spark, tmp_path, again):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(60)]
    rows += [(i, rows[20 * (n + 1)][1], label) for n, (i, label) in enumerate(again)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    chunks = catalog.vector_chunks(spark, str(tmp_path))
    asked = catalog.vector_questions(chunks).withColumnRenamed("question_id", "case_id")
    got = search.vector_search(chunks, asked, limit=10, keys=["case_id"])
    assert {7} <= {r["chunk_id"] for r in got.collect()}
    labels = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("case_id"), "document_id")
    want = evaluate.rank_metrics(got, labels.join(chunks.select("chunk_id", "document_id"), "document_id")).withColumn("value", F.round("value", 6))
    assert sorted(map(tuple, catalog.QUERIES["rank_metrics_chunk"](spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))
