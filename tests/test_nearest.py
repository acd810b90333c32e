import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import METRICS, distance
from tessella.operators import ann, nearest, search

ROWS = "chunk_id long, document_id long, tenant_id string, tags map<string,string>, embedding array<double>"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nearest, "CHUNKS", 32)
    monkeypatch.setattr(nearest, "QUESTIONS", 16)


def vectors(spark, n=300, dim=8, seed=3):
    """Random vectors, groups of equal ones, and some of every odd kind."""
    rng = random.Random(seed)
    odd = [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1e200] * dim, [1e-200] * dim, [1e20] * dim, [1.0] * (dim - 1), [1.0] * (dim + 1), [-2.0] * dim]
    copies = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    one = lambda i: odd[i // 5 % len(odd)] if i % 5 == 0 else copies[i % 4] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(dim)]
    return spark.createDataFrame([(i, i % 7, "abc"[i % 3] if i % 11 else None, {"i": str(i)}, one(i)) for i in range(n)], ROWS)


def by_pairs(chunks, asked, metric, limit, most, scope):
    """The first by the expression over all pairs."""
    lean = chunks.select("chunk_id", "document_id", "tags", *scope, "embedding")
    pairs = lean.join(asked, scope) if scope else lean.crossJoin(asked)
    found = pairs.select("question_id", "chunk_id", "document_id", "tags", distance(F.col("embedding"), F.col("query_embedding"), metric).alias("distance"))
    found = found if most is None else found.where(F.col("distance") <= most)
    held: dict = {}
    for r in found.collect():
        held.setdefault(r["question_id"], []).append(r)
    order = lambda r: (r["distance"] is None, r["distance"] != r["distance"], r["distance"] if r["distance"] == r["distance"] else 0, r["chunk_id"])
    return {(q, n, r["chunk_id"], r["document_id"], r["tags"]["i"], repr(r["distance"])) for q, rows in held.items() for n, r in enumerate(sorted(rows, key=order)[:limit], 1)}


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("limit,most,scoped", [(5, None, False), (20, 0.7, True)])
def test_the_same_as_all_pairs_to_the_last_bit(spark, small_blocks, metric, limit, most, scoped):
    chunks = vectors(spark)
    scope = ["tenant_id"] if scoped else []
    asked = chunks.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("question_id"), *scope, F.col("embedding").alias("query_embedding"))
    got = search.vector_search(chunks if scoped else chunks.drop("tenant_id"), asked, metric=metric, limit=limit, maximum_distance=most, keys=["question_id"], carry=["tags"])
    assert got.columns == ["question_id", "chunk_id", "document_id", "tags", "distance", "rank"]
    assert {(r["question_id"], r["rank"], r["chunk_id"], r["document_id"], r["tags"]["i"], repr(r["distance"])) for r in got.collect()} == by_pairs(chunks, asked, metric, limit, most, scope)


@pytest.mark.parametrize("how", ["ann", "search"])
def test_vectors_meet_in_blocks(spark, small_blocks, how):
    """No expression over pairs of rows, for which the plans were too slow."""
    chunks = vectors(spark).where("embedding is not null and size(embedding) = 8 and chunk_id % 5 > 0").drop("tenant_id", "tags")
    asked = chunks.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"))
    found = ann.search(ann.build(chunks, lists=4), asked, probes=2) if how == "ann" else search.vector_search(chunks, asked, keys=["question_id"])
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 5 * asked.count()


def test_lists_that_no_question_reads_are_left_out(spark, small_blocks):
    chunks = vectors(spark).where("embedding is not null and size(embedding) = 8 and chunk_id % 5 > 0").drop("tenant_id", "tags")
    asked = chunks.where("chunk_id < 20").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"))
    index = ann.build(chunks, lists=8)
    lists = index.rows.select("list_no", F.col("chunk_id")).collect()
    of = {r["chunk_id"]: r["list_no"] for r in lists}
    for r in ann.search(index, asked, limit=3, probes=1).collect():
        assert of[r["chunk_id"]] == of[r["question_id"]]


def test_unknown_metric(spark):
    rows = vectors(spark, 5)
    with pytest.raises(ValueError):
        search.vector_search(rows, rows.selectExpr("chunk_id question_id", "embedding query_embedding"), keys=["question_id"], metric="other")


@pytest.mark.parametrize("odd", [False, True])
def test_whole_steps_lose_no_pair(odd):
    """rrf_weighted's l1: once a question has a distance to beat, bytes rule pairs out, before float32 did for every pair."""
    rng = np.random.default_rng(1)
    for scale, shift in ((1.0, 0.0), (1e-6, 3e-6), (1e6, -5e6)):
        m, asks = rng.normal(size=(2000, 16)) * scale + shift, rng.normal(size=(30, 16)) * 1.2 * scale + shift
        if odd:
            m[7], m[9] = np.nan, 1e200
        sizes = lambda x: np.full(len(x), 16, np.int32)
        c, q = nearest._side(sizes(m), m, 16, 16, "l1"), nearest._side(sizes(asks), asks, 16, 16, "l1")
        steps = nearest._Steps.of(c)
        with np.errstate(all="ignore"):
            d = np.abs(m[None] - asks[:, None]).sum(2)
        bound = np.sort(np.where(c.odd, np.inf, d), 1)[:, 4]
        codes, off = steps.codes(q)
        qi, ci = steps.near(q, codes, off, c, bound)
        got = set(zip(qi.tolist(), ci.tolist()))
        assert {(i, j) for i in range(30) for j in range(2000) if c.odd[j] or d[i, j] <= bound[i]} <= got
        assert len(got) < 30 * (8 + 2 * odd)


def test_a_task_keeps_the_least_distances(spark):
    """vector_threshold: no block alone has `limit` near chunks, so before no block brought the distance down."""
    rng = np.random.default_rng(2)
    m, asks = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    sizes = lambda x: np.full(len(x), 8, np.int32)
    bound, best, returned = np.full(5, 2.0), np.full((5, 30), np.inf), 0
    for at in range(0, 200, 20):
        c, q = (nearest._side(sizes(x), x, 8, 8, "cosine") for x in (m[at : at + 20], asks))
        returned += len(nearest._nearest_of(q, c, nearest._across(c, "cosine"), bound, 30, "cosine", 2.0, best)[0])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.sort(1 - unit(asks) @ unit(m).T, 1)[:, :30]
    assert np.allclose(np.sort(best, 1), want) and np.allclose(bound, want[:, -1])
    assert returned < 5 * 200 * 0.7


@pytest.mark.parametrize("limit,most", [(5, None), (10, None), (30, 0.7)])
def test_more_shuffle_partitions_are_not_more_rows_to_rank(spark, limit, most):
    """Every task returns its own first rows of a question: at 200 partitions that was most of the searches' time."""
    rng = random.Random(9)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>").repartition(2)
    asked = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"))

    def count(partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return nearest.nearest(chunks, asked, keys=["question_id"], names=["chunk_id"], scope=[], metric="cosine", limit=limit, maximum_distance=most).count()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    few, many = count("4"), count("64")
    assert 75 * limit <= few <= 75 * limit * 12 and many == few


@pytest.mark.parametrize("limit", [5, 10])
def test_tasks_return_no_more_than_their_first_rows(spark, small_blocks, limit):
    """Before, a task returned what was near in one block and farther than what later blocks had."""
    rng = random.Random(11)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>")
    asked = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query_embedding"))
    found = nearest.nearest(chunks, asked, keys=["question_id"], names=["chunk_id"], scope=[], metric="cosine", limit=limit)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 75 * limit * 6


def test_rows_wait_within_bounds(monkeypatch):
    monkeypatch.setattr(nearest, "WAITING_BYTES", 4000)
    rng = np.random.default_rng(3)
    d, waiting, bound, got = rng.random((40, 50)), nearest._Waiting(), np.full(1, np.inf), []
    for block in d:
        table = nearest.pa.table({"d": block})
        got += waiting.add(bound, np.zeros(50, int), block, np.zeros(50, bool), table)
        assert waiting.size <= 4000
        bound[0] = min(bound[0], np.sort(d[d <= block.max()])[9])
    got = np.concatenate([b.column("d").to_numpy() for b in [*got, *waiting.all()]])
    assert set(d[d <= bound[0]]) <= set(got) <= set(d.ravel()) and len(got) == len(set(got)) and not waiting.held
