"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

Forward probabilities are filtered once for each distinct unit of a batch; they turn every node into a distribution
over the arcs that enter it. Backward sampling then walks from all units' ends to their starts at once. The random
number of a step depends on nothing but the seed, the row key, the unit's number in the text and the step, so a
row's segmentation is the same in any partitioning, batch or retry.

Defined cases: null text gives null ids, empty text no ids; a null key counts as 0; repeated rows (same key and text)
get the same segmentation. Decoding returns the very text: spaces, marks, controls and unknown characters included. A
text of any length is segmented whole; a unit without spaces, however long, is filtered block by block, with a number for
each character held. There are no ties: a draw falls on one arc. An empty table gives no rows. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import vocabulary
from tessella.llm.lattice import SHORT, Lattices, LongUnit, Vocabulary, byte_pieces, load, rank_weights, units

VOCABULARY = "piece_bpe_32k.model"
SEED = 17
ALPHA = 1.0  # smoothing: segmentations are drawn in proportion to probability ** ALPHA
BATCH_CHARACTERS = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(stream: np.ndarray, step) -> np.ndarray:
    """32 random bits for each stream at a step, or for one stream at each of many steps."""
    with np.errstate(over="ignore"):
        return _mix(stream + (np.asarray(step).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)


def _uniforms(stream: np.uint64, steps: np.ndarray) -> np.ndarray:
    return _random(stream, steps).astype(float) / 2.0**32


class Common(NamedTuple):
    """Lattices of the units that a worker met most often: they are filtered once and used by every later batch."""

    number: dict[str, int]
    starts: int
    edge: np.ndarray
    src: np.ndarray
    ids: np.ndarray
    end: np.ndarray


COMMON_AFTER = 4_000_000  # characters that a worker has read before it chooses
COMMON_UNITS = 100_000
_seen: dict[tuple, tuple[Counter, list]] = {}
_common: dict[tuple, Common] = {}


def _common_units(which: tuple, distinct, size: int, path: str, prob: np.ndarray) -> Common | None:
    """The worker's common units once it has read enough; `which` names vocabulary and weights. What a unit's lattice
    gives does not depend on where it is filtered, so this changes no result."""
    if which not in _common:
        counter, read = _seen.setdefault(which, (Counter(), [0]))
        counter.update(distinct)
        read[0] += size
        if read[0] < COMMON_AFTER:
            return None
        chosen = [u for u, n in counter.most_common(COMMON_UNITS) if n > 1 and len(u) <= SHORT]
        del _seen[which]
        made = Lattices(chosen, path, prob)
        _common[which] = Common({u: i for i, u in enumerate(chosen)}, made.n, made.edges(), made.src, made.ids, made.end)
    return _common[which]


def sample(keys: np.ndarray, texts: list[str], path: str, prob: np.ndarray, seed: int) -> list[np.ndarray]:
    """One segmentation of every text."""
    model = load(path)
    split = [units(t) for t in texts]
    sizes = np.array([len(u) for u in split], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int32) for _ in texts]
    number = dict.fromkeys(chain.from_iterable(split))
    number.update(zip(number, range(len(number))))
    which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        stream = _mix(_mix(keys.astype(np.uint64)[doc] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) + place.astype(np.uint64))
    distinct = list(number)
    stock = _common_units((path, seed, float(prob.sum()), float(prob.max())), distinct, sum(map(len, texts)), path, prob)
    home = np.full(len(distinct), -1, np.int64) if stock is None else np.fromiter(map(stock.number.get, distinct, repeat(-1)), np.int64, len(distinct))
    short = np.fromiter(map(len, distinct), np.int64, len(distinct)) <= SHORT
    fresh = short & (home < 0)
    index = np.cumsum(fresh) - 1
    lattices = Lattices([distinct[i] for i in np.flatnonzero(fresh).tolist()], path, prob)
    # draws: (number of the unit in the batch, minus the step, id); a unit's last piece is drawn first
    whose, when, what = [], [], []
    of_stock = home[which] >= 0
    for starts, edge, src, ids, unit, node in (
        (lattices.n, lattices.edges(), lattices.src, lattices.ids, u := np.flatnonzero(fresh[which]), lattices.end[index[which[u]]]),
        *([(stock.starts, stock.edge, stock.src, stock.ids, u := np.flatnonzero(of_stock), stock.end[home[which[u]]])] if stock else []),
    ):
        step = 0
        while len(unit):
            arc = np.searchsorted(edge, (node.astype(np.uint64) << np.uint64(32)) + _random(stream[unit], step), side="right")
            whose.append(unit)
            when.append(np.full(len(unit), -step, np.int32))
            what.append(ids[arc])
            node = src[arc]
            go = node >= starts  # the first nodes are the units' starts
            unit, node, step = unit[go], node[go], step + 1
    for k in np.flatnonzero(~short):
        found = np.flatnonzero(which == k)
        for at, ids in zip(found, LongUnit(distinct[k], path, prob).sample(stream[found], _uniforms)):
            whose.append(np.full(len(ids), at))
            when.append(np.arange(len(ids), dtype=np.int32))
            what.append(ids)
    whose, when, what = (np.concatenate(x) for x in (whose, when, what))
    order = np.lexsort((when, whose))
    flat, owner = what[order], doc[whose[order]]
    odd = np.flatnonzero(flat < 0)
    if len(odd):  # characters in bytes
        pieces = {int(c): byte_pieces(int(c), model) for c in np.unique(flat[odd])}
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(pieces[int(c)]) for c in flat[odd]]
        starts = np.cumsum(times) - times
        spread = np.repeat(flat, times)
        owner = np.repeat(owner, times)
        for at, c in zip(starts[odd].tolist(), flat[odd].tolist()):
            spread[at : at + len(pieces[c])] = pieces[c]
        flat = spread
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return np.split(flat.astype(np.int32), ends[:-1])


def groups(texts: list[str | None]) -> Iterator[slice]:
    """Consecutive texts of about BATCH_CHARACTERS together, so that what is held at a time is bounded."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < BATCH_CHARACTERS or end == at):
            size += len(texts[end] or "")
            end += 1
        yield slice(at, end)
        at = end


def decode(ids, vocabulary: Vocabulary) -> str:
    return b"".join(map(vocabulary.raw.__getitem__, ids)).decode()


def sampled_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_pieces, piece_ids, ids_crc32 (of little-endian unsigned 32-bit ids), lossless
    (whether decoding gives the text back)."""
    path = path or vocabulary(VOCABULARY)

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        weight = np.exp(alpha * rank_weights(model))
        raw = model.raw.__getitem__
        for batch in batches:
            doc_ids, keys, texts = batch["doc_id"], batch["key"].to_numpy(np.int64), batch["text"].tolist()
            del batch
            for part in groups(texts):
                some, rows = texts[part], []
                for text, ids in zip(some, sample(keys[part], [t or "" for t in some], path, weight, seed)):
                    if text is None:
                        rows.append((None, None, None, None))
                    else:
                        rows.append((len(ids), ids, zlib.crc32(ids.astype("<u4").tobytes()), b"".join(map(raw, ids.tolist())) == text.encode()))
                frame = pd.DataFrame(rows, columns=["n_pieces", "piece_ids", "ids_crc32", "lossless"])
                frame.insert(0, "doc_id", doc_ids.iloc[part].to_numpy())
                yield frame.astype({"doc_id": "Int64", "n_pieces": "Int64", "ids_crc32": "Int64", "lossless": "boolean"})

    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("key"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(segment, "doc_id long, n_pieces long, piece_ids array<int>, ids_crc32 long, lossless boolean")


def decoded(encoded: DataFrame, *, ids_col: str = "piece_ids", path: str | None = None, out: str = "text") -> DataFrame:
    """encoded with the decoded text added."""
    path = path or vocabulary(VOCABULARY)

    @F.pandas_udf("string")
    def join(column: pd.Series) -> pd.Series:
        model = load(path)
        return pd.Series([None if ids is None else decode(ids, model) for ids in column], dtype=object)

    return encoded.withColumn(out, join(F.col(f"`{ids_col}`")))
