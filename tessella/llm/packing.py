"""Best-fit packing by minimum bin slack.

Documents become token ids and an end id; longer ones than a sequence are cut into full pieces behind a first piece
that may be shorter. Only the pieces' lengths decide a packing, and there are at most `size` of them, so the plan is
made from the histogram of lengths: for each bin the longest available length is placed, then a bitset of reachable
sums over the other available lengths finds the fullest combination, which is removed - as many times at once as the
histogram allows, so there are about as many plan entries as distinct lengths, however many documents there are.

Each piece finds its place by its rank among the pieces of its length. Ranks come from counts by (length, bucket) and
a row number inside a bucket, so a length that many copies share is not one task. A length has a bucket for every
`bucket` pieces; from 65,536 buckets on the buckets grow instead, so that a length's counts stay a short list.

Defined cases: null text is empty and gives one piece that holds the end id; a text of any length is encoded part by
part and cut into pieces; repeated rows are packed one by one; ties (equal lengths) are placed by id, piece and
checksum; an empty table gives no rows; columns of docs other than the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import SAFE_SPACE, byte_level_ranks, tokenizer, vocabulary
from tessella.llm.common import cut

SIZE = 2048
END_ID = 0
BUCKET = 1000
MAX_BUCKETS = 1 << 16
VOCABULARY = "byte_bpe_50k.json"
LONG = 1 << 20  # characters; longer texts are encoded part by part
_BREAK = re.compile(SAFE_SPACE)
#: White space in such runs, and special tokens, are left to the library that defines the ids.
_ODD = re.compile(r"\s{512}")


def _parts(text: str) -> Iterator[str]:
    """A text cut before safe spaces into parts of about LONG characters; a part without such a space stays whole.

    The pre-tokenizer puts a single space with the word behind it, so the parts' ids are the text's ids."""
    start = 0
    while len(text) - start > LONG:
        found = _BREAK.search(text, start + LONG)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(text: str | None, path: str) -> np.ndarray:
    """The ids of a whole text, as the tokenizers library gives them.

    Byte-level BPE by ranks gives the same ids faster; it is used where the file's merges are in the order of their ids
    (see byte_level_ranks), for text without special tokens and without huge runs of white space."""
    ranks, specials = byte_level_ranks(path)
    text = text or ""
    found: list[np.ndarray] = []
    for part in _parts(text):
        if ranks is not None and not _ODD.search(part) and not any(s in part for s in specials):
            ids = ranks.encode_ordinary(part)
        else:
            ids = tokenizer(path).encode_batch_fast([part], add_special_tokens=False)[0].ids
        found.append(np.array(ids, "<u4"))
    return found[0] if len(found) == 1 else np.concatenate(found)


def cut_pieces(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    short = n % size or min(n, size)
    return [(0, short)] + [(s, size) for s in range(short, n, size)] if n else []


def tokenise(docs: DataFrame, *, id_col: str, text_col: str, size: int, end_id: int, path: str) -> DataFrame:
    end = np.array([end_id], "<u4")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.concatenate([encode_text(text, path), end])
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut_pieces(len(ids), size))]
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan(NamedTuple):
    keys: np.ndarray  # length << 40 | first rank, sorted
    first: np.ndarray  # first rank
    per_bin: np.ndarray
    bin_from: np.ndarray
    offset: np.ndarray


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Of the available lengths (with counts), a combination whose sum is the greatest not above room."""
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            more = (sums | sums << length) & full
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room & 1:
            break
    left, taken = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return taken


def plan_bins(counts: dict[int, int], size: int) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """Patterns (times, {length: count}) that use up counts, and how many bins that makes."""
    left = {k: v for k, v in counts.items() if v > 0}
    patterns, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: v for k, v in left.items() if v}
        pattern: dict[int, int] = {longest: 1}
        for length in fullest(rest, size - longest):
            pattern[length] = pattern.get(length, 0) + 1
        left[longest] += 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        patterns.append((times, pattern))
        bins += times
    return patterns, bins


def place(patterns: list[tuple[int, dict[int, int]]]) -> Plan:
    used: dict[int, int] = {}
    rows, bins = [], 0
    for times, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            first = used.get(length, 0)
            rows.append((length << 40 | first, first, n, bins, offset))
            used[length] = first + n * times
            offset += n * length
        bins += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, path: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or vocabulary(VOCABULARY)
    pieces = cut(tokenise(docs, id_col=id_col, text_col=text_col, size=size, end_id=end_id, path=path), "packing-pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))  # at most `size` rows
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    plan = place(plan_bins(histogram, size)[0])
    buckets = F.broadcast(lengths.select("length", F.least(F.ceil(F.col("n") / bucket), F.lit(MAX_BUCKETS)).alias("buckets")))
    dealt = pieces.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["rank"].to_numpy(np.int64)
            at = np.searchsorted(plan.keys, length << 40 | rank, side="right") - 1
            r = rank - plan.first[at]
            b["sequence_id"] = plan.bin_from[at] + r // plan.per_bin[at]
            b["offset"] = plan.offset[at] + r % plan.per_bin[at] * length
            yield b[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
