import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import topk


def plain(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in good:
        if i % every == 0:
            asks[i] = v if i not in asks else asks[i]
    out = []
    for i, q in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, every=5, k=5, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    return sorted(tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(every)) == 0, k=k, **how).select("query_id", "rank", "vec_id", "score").collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(90, 130)]  # one very common vector: ties
    for how in ({}, {"bins": 3, "per_block": 7, "per_query_block": 4, "group": 2}):
        assert run(spark, rows, **how) == plain(rows, 5, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [0.5, -3.0]), (10, [1.0]), (15, [])]
    assert run(spark, rows) == plain(rows, 5, 5)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e6, -3e6]), (1, [2e6 + 0.01, 1e6]), (2, [2e6, 1e6]), (3, [1e7, 1e6 + 0.5])]
    assert run(spark, rows, bins=64) == plain(rows, 5, 5)


def test_scores_near_the_end_of_a_long(spark):
    # 256 * x; scores up to just below 2 ** 63, and their negatives
    rows = [(0, [8e6]), (1, [9e6]), (2, [1.0]), (3, [-9e6]), (5, [1.186e7]), (4, [1.186e7]), (6, [0.0])]
    want = plain(rows, 5, 5)
    assert max(r[3] for r in want) > 2**62 and (0, 1, 4, math.floor(256 * 8e6) * math.floor(256 * 1.186e7)) in want
    for how in ({}, {"bins": 300, "per_block": 2}):
        assert run(spark, rows, **how) == want


def test_a_score_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2e7]), (1, [2e7])])


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [1.0]), (1, [1.0])]) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
