"""Groups of any size compared in tasks of bounded size.

A group of more than `block` rows is dealt into blocks, and each pair of blocks is a task; a task returns at most one
link for each of its rows, to the least row of its cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """rows with (lo, hi, block) for each pair of blocks of its group that a row takes part in, sorted by pair. size: the group's rows."""
    rows = rows.withColumn("__blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("block", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    rows = rows.withColumn("__pair", F.explode(pairs)).select("*", "__pair.lo", "__pair.hi").drop("__pair", "__blocks", size)
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by keys, one by one, also those that go over the end of a batch."""
    kept: list[pd.DataFrame] = []
    for frame in batches:
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1), len(frame)]
        if kept and (kept[-1][keys].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(kept, ignore_index=True)
            kept = []
        for a, b in zip(edges, edges[1:]):
            kept.append(frame.iloc[a:b])
            if b < len(frame):
                yield pd.concat(kept, ignore_index=True)
                kept = []
    if kept:
        yield pd.concat(kept, ignore_index=True)


def stars(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) of every row that links (a, b) join to one that is less by `order`; root is its cluster's least."""
    by = np.argsort(order, kind="stable")
    label = np.argsort(by, kind="stable")
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[by[new]]  # jump to the label of the label's own row
        if (new == label).all():
            break
        label = new
    root = by[label]
    moved = np.flatnonzero(root != np.arange(len(order)))
    return moved, root[moved]
