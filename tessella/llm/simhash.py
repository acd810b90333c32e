"""SimHash near-duplicates by anchor-point covering.

Anchors are the 65,536 words of the extended BCH code [64, 16, 24]. A fingerprint's home is its nearest anchor, at
distance m (never above the code's covering radius). It is replicated to every anchor within m + `bits`; anchors'
rows are compared home against all. This is complete: of two fingerprints at most `bits` apart let x be the one no
farther from its home h; the other, y, has d(y, h) <= m(x) + bits <= m(y) + bits, so it is sent to h and meets x.

Equal fingerprints are one row before replication, so a group of copies costs one row. An anchor with more than
`block` rows is dealt into pairs of blocks, each compared in a task of its own; a task returns at most one link for
each of its rows (to the least fingerprint of its cluster), never all pairs. Components are found on these links.

Defined cases: null or wordless text has fingerprint zero, linked like any other; with fewer words than a shingle the
whole sequence is the one shingle; repeated rows are rows of one group; a null doc_id keeps its row and counts as
larger than every id; a text of any length is fingerprinted whole, 65,536 shingles at a time; fingerprints that tie at
half the shingles have a zero there, and of equally near anchors the first is home; an empty table gives no rows. Other
columns, whatever their names, are not read, and deduplicate() hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import stars
from tessella.llm.common import cut, drop_cut, unpacked, whole_row
from tessella.llm.components import connected_components

SEED = 42
BITS = 3
SHINGLE = 3
BLOCK = 2048
PAIRS_AT_ONCE = 1 << 20  # fingerprints that are compared at a time: 8 MB
AT_ONCE = 1 << 16  # shingles whose bits are unpacked at a time: 4 MB


def _shingles(text: str | None, width: int) -> list[bytes]:
    # bytes.lower() changes A-Z only and bytes.split() splits at \x20 and \x09-\x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, unsigned."""
    return int(fingerprints([text], width)[0])


def fingerprints(texts, width: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held: list[np.ndarray] = []
    starts: list[int] = []
    whose: list[int] = []
    size = 0

    def count(h: np.ndarray) -> np.ndarray:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")

    def flush() -> None:
        nonlocal held, starts, whose, size
        if held:
            ones = np.add.reduceat(count(np.concatenate(held)), starts, axis=0, dtype=np.int32)
            n = np.diff(np.append(starts, size))
            out[whose] = ((ones * 2 > n[:, None]) * weights).sum(1, dtype=np.uint64)
        held, starts, whose, size = [], [], [], 0

    for i, text in enumerate(texts):
        grams = _shingles(text, width)
        if not grams:
            continue
        h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
        if len(h) > AT_ONCE:
            ones = sum(count(h[k : k + AT_ONCE]).sum(0, dtype=np.int64) for k in range(0, len(h), AT_ONCE))
            out[i] = ((ones * 2 > len(h)) * weights).sum(dtype=np.uint64)
            continue
        held.append(h)
        starts.append(size)
        whose.append(i)
        size += len(h)
        if size >= AT_ONCE:
            flush()
    flush()
    return out


def fingerprint_column(width: int = SHINGLE):
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(texts.tolist(), width).view(np.int64))

    return simhash


@lru_cache(1)
def anchors() -> np.ndarray:
    """Half of the code's words; the other half are their complements. Sorted, so that indices are the same everywhere."""
    power = [1]
    for _ in range(62):  # the powers of a root of x^6 + x + 1 over GF(2)
        p = power[-1] << 1
        power.append(p ^ 0b1000011 if p & 64 else p)
    log = {v: i for i, v in enumerate(power)}
    mul = lambda a, b: power[(log[a] + log[b]) % 63] if a and b else 0
    roots = {e * 2**k % 63 for e in range(1, 23) for k in range(6)}  # designed distance 23
    g = [1]
    for r in sorted(roots):
        g = [(g[i - 1] if i else 0) ^ (mul(power[r], g[i]) if i < len(g) else 0) for i in range(len(g) + 1)]
    word = sum(c << i for i, c in enumerate(g))
    basis = [w | (w.bit_count() & 1) << 63 for w in (word << i for i in range(63 - len(g) + 1))]
    code = np.zeros(1, np.uint64)
    for b in basis:
        code = np.concatenate([code, code ^ np.uint64(b)])
    return np.sort(code[code < np.uint64(1 << 63)])


def _replicas(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of every anchor that each fingerprint goes to."""
    half = anchors()
    x, d = np.empty_like(half), np.empty(len(half), np.uint8)
    rows, at, home = [], [], []
    for i, fp in enumerate(fps):
        np.bitwise_xor(half, fp, out=x)
        np.bitwise_count(x, out=d)
        near, far = int(d.min()), 64 - int(d.max())
        m = min(near, far)
        own = np.flatnonzero(d <= m + bits)
        other = np.flatnonzero(d >= 64 - m - bits)
        a = np.concatenate([own, other + len(half)])
        first = int(d.argmin()) if near <= far else int(d.argmax()) + len(half)
        rows.append(np.full(len(a), i))
        at.append(a)
        home.append(a == first)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(at), np.concatenate(home)


def _clusters(fp: np.ndarray, home: np.ndarray, block: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the least fingerprint of its cluster in this task; home rows against all (of the other block, if there are two)."""
    h = np.flatnonzero(home)
    two = block.min() != block.max()
    order = fp.view(np.int64)
    left, right = [], []
    step = max(1, PAIRS_AT_ONCE // len(fp))
    for k in range(0, len(h), step):
        part = h[k : k + step]
        near = np.bitwise_count(fp[part][:, None] ^ fp[None, :]) <= bits
        near &= block[part][:, None] != block[None, :] if two else fp[part][:, None] != fp[None, :]
        i, j = np.nonzero(near)
        if len(i):  # of the pairs, only links to each cluster's least row are kept
            row, root = stars(order, part[i], j)
            left.append(row)
            right.append(root)
    if not left:
        return fp[:0], fp[:0]
    row, root = stars(order, np.concatenate(left), np.concatenate(right))
    return fp[row], fp[root]


def _compare(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by group; a group may go over the end of a batch and never has more than two blocks of rows."""
    kept: pd.DataFrame | None = None

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        fp, home, block = frame["fp"].to_numpy().view(np.uint64), frame["home"].to_numpy(bool), frame["block"].to_numpy()
        change = np.flatnonzero((frame[["anchor", "lo", "hi"]].to_numpy()[1:] != frame[["anchor", "lo", "hi"]].to_numpy()[:-1]).any(1)) + 1
        out = [_clusters(fp[s:e], home[s:e], block[s:e], bits) for s, e in zip(np.append(0, change), np.append(change, len(fp))) if e - s > 1 and home[s:e].any()]
        a, b = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    for frame in batches:
        frame = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[["anchor", "lo", "hi"]].iloc[-1]
        open_ = (frame["anchor"] == last["anchor"]) & (frame["lo"] == last["lo"]) & (frame["hi"] == last["hi"])
        kept, done = frame[open_], frame[~open_]
        if len(done):
            yield links(done)
    if kept is not None and len(kept):
        yield links(kept)


def link_fingerprints(fps: DataFrame, *, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """fps: distinct fingerprints in a column fp (long). Returns links (a, b) whose components are those of all pairs
    that differ in at most `bits` bits."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            values = frame["fp"].to_numpy().view(np.uint64)
            for k in range(0, len(values), 4096):
                row, at, home = _replicas(values[k : k + 4096], bits)
                yield pd.DataFrame({"anchor": at.astype(np.int32), "fp": values[k + row].view(np.int64), "home": home})

    # fingerprints are few bytes but much work: a given number of partitions is not coalesced by size
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = cut(spread.mapInPandas(replicate, "anchor int, fp long, home boolean"), "simhash-anchors")
    # one row an anchor: at most 65,536 rows
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n")).select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(sizes), "anchor").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("anchor", "pair.lo", "pair.hi", "block", "fp", "home")
    grouped = dealt.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi")
    links = cut(grouped.mapInPandas(lambda it: _compare(it, bits), "a long, b long"), "simhash-links")
    drop_cut(placed)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row a document: (doc_id, fp long, component_id: the least id of the fingerprints that links reach, root: the
    component's least fingerprint, content: a hash of the text). Components may share a component_id, but not a root."""
    text = F.col(f"`{text_col}`")
    marked = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(width)(text).alias("fp"), F.xxhash64(text).alias("content")), "simhash-fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(link_fingerprints(distinct, bits=bits, block=block)).toDF("fp", "root")
    rooted = cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = cut(rooted.join(least, "root").select("fp", "component_id", "root"), "simhash-named")
    for gone in (distinct, rooted, least):
        drop_cut(gone)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root", "content")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their component: least id, then least text hash. All of docs' columns are kept."""
    found = near_duplicates(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    # a component without any id keeps the row with the least text hash
    copies = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "content").agg(F.count("*").alias("n"))
    least = copies.groupBy("root").agg(F.min(F.struct("content", "doc_id", "n")).alias("first"))
    first = cut(least.select(F.col("first.doc_id").alias("first_id"), F.col("first.content").alias("first_content"), F.col("first.n").alias("n")), "simhash-first")
    rows = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"))
    # texts move once, to meet the ids that stay
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content")))
    if not first.where("n > 1").isEmpty():  # rows that are equal in id and text: one of them stays
        kept = kept.dropDuplicates(["id", "content"])
    return unpacked(kept, docs.columns)
