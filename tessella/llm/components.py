"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Nothing is collected but two sums a round. Every round's edges are cut into the shared folder, so a lost executor
costs one round's tasks and Spark may split the rows of a hot node when it joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b). Large: link each node's larger neighbours to its least neighbour. Small: the same for the others and itself."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    done = cut(out.where("a <> b").distinct(), "components-edges")
    drop_cut(least)
    return done


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs, in any direction, repeats and loops allowed.

    Returns (node, root) for every node that has an edge to another one; root is the component's least node."""
    now = cut(edges.toDF("a", "b").where("a <> b").distinct(), "components-edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        large = _star(now, True)
        drop_cut(now)
        now = _star(large, False)
        drop_cut(large)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # stars by now: every edge runs from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
