"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every block of candidates and scores all pairs with one
matrix product. A pass counts scores in a global histogram for each query: BINS equal parts of the interval that is
known to hold the query's k-th best score. The bin that holds it becomes the next interval, until bins are single
scores; then candidates at or above it are kept, ties by smaller id.

A block reports only its bins from its own k-th best score upwards: the global k-th best is never below a block's
own, so no count that decides is left out, and a block sends at most about k bins a query however many vectors tie.

The queries are a stated set: each is needed by every block of candidates. They are copied once for every `group`
candidate blocks, so neither side is ever broadcast or held on the driver.

Scores are integers: components are floor(256 * x). They are computed in float64 while no sum can exceed 2**53 and
with Python's integers otherwise; a score that 64 bits can't hold is an error.

Defined cases: null vectors, vectors that hold null or a non-finite component, and rows without an id take no part.
Only vectors of equal length are compared. Of query rows with one id the least vector asks, and rows with that id are
never its candidates; otherwise repeated rows are candidates one by one. With fewer than k candidates all are returned;
an empty table gives no rows. Other columns of the table, whatever their names, are not read. Vectors of any length and
size are scored; there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, drop_cut

K = 5
BINS = 4096
CANDIDATES = 4096  # vectors in a block
QUERIES = 512
GROUP = 8
PAIRS_AT_ONCE = 1 << 20
LEAST, MOST = -(2**63), 2**63 - 1  # what a long holds
BLOCK = "dim int, block long, ids binary, vectors binary, wide boolean"


def _pack(rows: DataFrame, per_block: int) -> DataFrame:
    """Blocks of at most per_block vectors of equal length; ids as int64, components as int16 or float64."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pd.DataFrame:
            nonlocal number
            number += 1
            ids, vectors = held.pop(dim)
            m = np.floor(256.0 * np.array(vectors, np.float64).reshape(len(ids), dim))
            wide = bool(m.size and np.abs(m).max() > 32767)
            return pd.DataFrame({"dim": [dim], "block": [number], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [(m if wide else m.astype(np.int16)).tobytes()], "wide": [wide]})

        for batch in batches:
            for vec_id, vector in zip(batch["vec_id"], batch["embedding"]):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                vectors.append(vector)
                if len(ids) >= per_block:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return rows.mapInPandas(pack, BLOCK)


def _matrix(raw: bytes, wide: bool, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if wide else np.int16).reshape(n, dim).astype(np.float64)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = (np.abs(q).max() if q.size else 0) * (np.abs(c).max() if c.size else 0) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in q], object)
    if any(not LEAST <= x <= MOST for x in exact.ravel()):
        raise OverflowError("a score needs more than 64 bits")
    return exact.astype(np.int64)


def _each(batches: Iterator[pd.DataFrame], k: int):
    """For each pair of blocks, slice by slice: the query block's number, the queries' state (q, lo, hi, need), the
    scores, which of them lie in the query's interval, the candidates' ids, and the least score that can matter: the
    k-th best inside the interval, or the interval's start if the block has fewer."""
    low = np.iinfo(np.int64).min
    for batch in batches:
        for r in batch.itertuples(index=False):
            qids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
            q, c = _matrix(r.q_vectors, r.q_wide, r.dim, len(qids)), _matrix(r.vectors, r.wide, r.dim, len(ids))
            state = np.array([(x["q"], x["lo"], x["hi"], x["need"]) for x in r.state], np.int64).reshape(-1, 4)
            step = max(1, PAIRS_AT_ONCE // len(ids))
            for i in range(0, len(state), step):
                some = state[i : i + step]
                scores = _scores(q[some[:, 0]], c)
                inside = (scores >= some[:, 1:2]) & (scores <= some[:, 2:3]) & (qids[some[:, 0]][:, None] != ids[None, :])
                ranked = np.where(inside, scores, low)
                kth = np.partition(ranked, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(some), low)
                yield r.q_block, qids, some, scores, inside, np.maximum(kth, some[:, 1]), ids


def _bin(lo: np.ndarray, score: np.ndarray, width: int) -> np.ndarray:
    """The start of the bin, counted from lo, that holds each score. Distances may need all 64 bits, so they are unsigned."""
    w = np.uint64(width)
    with np.errstate(over="ignore"):
        return (lo.astype(np.uint64) + (score.astype(np.uint64) - lo.astype(np.uint64)) // w * w).astype(np.int64)


def _histogram(pairs: DataFrame, k: int, width: int) -> DataFrame:
    """(q_block, q, need, lo, n, reached): counts by bin, and how many scores lie in it or above it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q_block, _, some, scores, inside, least, _ in _each(batches, k):
            floor = _bin(some[:, 1], least, width)
            row, col = np.nonzero(inside & (scores >= floor[:, None]))
            lo = _bin(some[row, 1], scores[row, col], width)
            seen, n = np.unique(np.stack([some[row, 0], some[row, 3], lo], 1), axis=0, return_counts=True)
            yield pd.DataFrame({"q_block": q_block, "q": seen[:, 0], "need": seen[:, 1], "lo": seen[:, 2], "n": n})

    counted = pairs.mapInPandas(count, "q_block long, q long, need long, lo long, n long").groupBy("q_block", "q", "need", "lo").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("q_block", "q", "need").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("reached", F.sum("n").over(down))


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """Scores from each query's k-th best upwards; of a block's, the k first."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, qids, some, scores, inside, least, ids in _each(batches, k):
            row, col = np.nonzero(inside & (scores >= least[:, None]))
            score = scores[row, col]
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            start = np.searchsorted(row, np.arange(len(some)))
            first = np.arange(len(row)) - start[row] < k
            yield pd.DataFrame({"query_id": qids[some[row, 0]][first], "vec_id": ids[col][first], "score": score[first]})

    return pairs.mapInPandas(keep, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS, per_block: int = CANDIDATES, per_query_block: int = QUERIES, group: int = GROUP) -> DataFrame:
    """The k best candidates of every row for which is_query holds: query_id, rank, vec_id, score."""
    v = F.col(f"`{vector_col}`")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: number(x.cast("double"))))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), is_query.alias("asks"))
    candidates = cut(_pack(rows.select("vec_id", "embedding"), per_block), "topk-candidates")
    asking = rows.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = cut(_pack(asking, per_query_block), "topk-queries")
    n_blocks = candidates.count()
    groups = max(1, -(-n_blocks // group))
    bound = candidates.mapInPandas(_largest, "dim int, largest double").groupBy("dim").agg(F.max("largest").alias("largest")).collect()
    limit = max([int(r["dim"]) * int(r["largest"]) ** 2 for r in bound], default=0) + 1
    low, high = max(-limit, LEAST), min(limit, MOST)  # beyond these a score is an error
    asked = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("wide").alias("q_wide"))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor(F.octet_length("ids") / 8).cast("long") - 1)
    state = queries.select(F.col("block").alias("q_block"), F.explode(numbers).alias("q"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi"), F.lit(k).cast("long").alias("need"))

    def met(state: DataFrame) -> DataFrame:
        """Every block of queries that has state with every block of candidates."""
        by_block = state.groupBy("q_block").agg(F.collect_list(F.struct("q", "lo", "hi", "need")).alias("state"))
        copies = asked.join(by_block, "q_block").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        dealt = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
        return dealt.join(copies, ["group", "dim"]).drop("group", "block")

    width, few, last = high - low + 1, None, None
    while width > 1:
        width = -(-width // bins)
        bins_found = cut(_histogram(met(state), k, width), "topk-histogram")
        if last is not None:  # the first pass is read again for `few`
            drop_cut(last)
        if few is None:  # queries with fewer than k candidates want them all
            few = bins_found.groupBy("q_block", "q", "need").agg(F.max("reached").alias("reached")).where("reached < need").select("q_block", "q", F.lit(low).cast("long").alias("lo"))
        else:
            last = bins_found
        at = bins_found.where((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("n") < F.col("need")))
        end = F.when(F.col("lo") > high - width, high).otherwise(F.col("lo") + (width - 1))
        state = at.select("q_block", "q", "lo", end.cast("long").alias("hi"), (F.col("need") - F.col("reached") + F.col("n")).alias("need"))
    decided = state.select("q_block", "q", "lo").union(few).select("q_block", "q", "lo", F.lit(high).cast("long").alias("hi"), F.lit(k).cast("long").alias("need"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return _kept(met(decided), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            m = np.abs(np.frombuffer(r.vectors, np.float64 if r.wide else np.int16).astype(np.float64))
            yield pd.DataFrame({"dim": [r.dim], "largest": [m.max() if m.size else 0.0]})
