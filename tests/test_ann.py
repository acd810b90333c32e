import random

import pytest

from tessella.operators import ann, search


def vectors(spark, n, dim=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = [(i, i % 7, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_against_exact_search(spark, tmp_path, metric):
    rows = vectors(spark, 1500)
    asked = rows.where("chunk_id % 20 = 0").selectExpr("chunk_id as question_id", "embedding as query_embedding")
    want = {(r["question_id"], r["chunk_id"]) for r in search.vector_search(rows, asked, metric=metric, keys=["question_id"]).collect()}
    index = ann.build(rows, str(tmp_path / "index"), metric=metric, lists=24)
    assert index.rows.count() == 1500 and index.rows.select("list_no").distinct().count() > 10
    few = {(r["question_id"], r["chunk_id"]) for r in ann.search(index, asked, probes=6).collect()}
    assert len(few & want) / len(want) >= 0.9
    every = {(r["question_id"], r["chunk_id"]) for r in ann.search(index, asked, probes=24).collect()}
    assert every == want


def test_empty_and_null_vectors(spark):
    rows = vectors(spark, 5)
    assert ann.search(ann.build(rows.where("false")), rows.selectExpr("chunk_id as question_id", "embedding as query_embedding")).count() == 0
    with_null = rows.selectExpr("chunk_id", "document_id", "if(chunk_id = 2, null, embedding) as embedding")
    assert ann.build(with_null, lists=2).rows.count() == 4
