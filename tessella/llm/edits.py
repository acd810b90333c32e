"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the walk stands on a character, and a random bit that depends on j and
that character alone says whether it moves on. Texts that agree from some point walk alike, and after an edit two
walks meet again, so a small edit distance becomes a small Hamming distance of what the walks saw.

A fingerprint samples the walk at fixed random steps, SAMPLES in every doubling of the number of steps, so texts of
all lengths share steps and whole texts are covered; each sample is a hex digit that hashes the characters there.
Likeness is the agreement of two fingerprints, each doubling weighted by its steps, less what chance gives.

near_duplicates() bands the sampled digits, verifies candidates by likeness and finds groups. neighbours() compares
every document with the next and with its own edited text. For that, documents are dealt into ranges of descending
ids whose bounds are ids of the table; the first document of a range also goes to the range before it, as the
successor of its last. One shuffle of the texts is all it takes, and no task holds more than its range.

Defined cases: null text is empty; an empty text has the fingerprint "", and likeness 1 to another empty text, 0 to
any other; a null id sorts behind all others; repeated ids are ordered by their texts' hashes, then texts, and rows that
tie in all of these are equal. Texts of any length are walked whole; a walked text takes some 50 bytes a character while
it is worked on. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import dealt, stars, whole_groups
from tessella.llm.common import cut, whole_row
from tessella.llm.components import connected_components

SEED = 29
PERIOD = 4096
SAMPLES = 32
GRAM = 4
OCTAVES = 40
ROWS_A_RANGE = 2000
MAX_RANGES = 100_000  # beyond 200 million documents ranges grow; a task reads its range as a stream
BANDS, BAND_DIGITS = 20, 7
NEAR = 0.8
BLOCK = 512


@lru_cache(1)
def _walk_table() -> list[list[int]]:
    """By class of character and step: how many steps the walk stays, the one that moves on included."""
    moves = np.random.default_rng(SEED).integers(0, 2, (256, PERIOD)).astype(bool)
    moves[:, PERIOD - 1] = True  # so that every stay ends within a period
    stay = np.ones((256, PERIOD), np.int64)
    for j in range(PERIOD - 2, -1, -1):
        stay[:, j] += np.where(moves[:, j], 0, stay[:, j + 1])
    return stay.tolist()


@lru_cache(1)
def _sample_steps() -> np.ndarray:
    """The sampled steps, ascending: the first SAMPLES, then SAMPLES random ones of every doubling."""
    rng = np.random.default_rng(SEED + 1)
    steps = [np.arange(SAMPLES)]
    low = SAMPLES
    for _ in range(OCTAVES - 5):
        steps.append(np.sort(rng.integers(low, 2 * low, SAMPLES)))
        low *= 2
    return np.concatenate(steps)


@lru_cache(1)
def _sample_weights() -> np.ndarray:
    return np.repeat(2.0 ** np.maximum(np.arange(OCTAVES - 4) - 1, 0), SAMPLES)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> bytes:
    return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes()


def walk(codes: np.ndarray, start: int = 0) -> np.ndarray:
    """The step at which the walk comes to each character, and the step behind the last one."""
    table, mask, j = _walk_table(), PERIOD - 1, start
    return np.array([start] + [j := j + table[c][j & mask] for c in _classes(codes)], np.int64)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _read(codes: np.ndarray, steps: np.ndarray) -> str:
    samples = _sample_steps()
    samples = samples[: np.searchsorted(samples, steps[-1])]
    at = np.searchsorted(steps, samples, side="right") - 1
    padded = np.concatenate([codes, np.zeros(GRAM, np.uint32)])
    h = np.zeros(len(at), np.uint32)
    for k in range(GRAM):
        h = (h ^ padded[at + k]) * np.uint32(0x01000193) + np.uint32(k)
    h ^= h >> np.uint32(15)
    return _HEX[(h * np.uint32(0x85EBCA6B)) >> np.uint32(28)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    codes = _codes(text or "")
    return _read(codes, walk(codes))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    n, m = sorted((len(a), len(b)))
    if not m:
        return 1.0
    weights = _sample_weights()[:m]
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    agree = float(weights[:n][same].sum() / weights.sum())
    return max(0.0, (agree - 1 / 16) / (1 - 1 / 16))


def _edited(text: str, codes: np.ndarray, steps: np.ndarray, other: str) -> tuple[str, str]:
    """The text whose last third is replaced by the start of another, and its fingerprint; the walk over what stays is used again."""
    cut_ = len(codes) // 3
    keep = len(codes) - cut_
    tail = other[:cut_]
    new = _codes(tail)
    walked = np.concatenate([steps[:keep], walk(new, int(steps[keep]))])
    return text[:keep] + tail, _read(np.concatenate([codes[:keep], new]), walked)


def _ranges(docs: DataFrame, id_col: str) -> np.ndarray:
    """Ascending ids of the table that end ranges; the last is the greatest id."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    n, most = docs.agg(F.count("*"), F.max(key)).first()
    if not n:
        return np.zeros(0, np.int64)
    parts = min(MAX_RANGES, -(-n // ROWS_A_RANGE))
    # percentile_approx returns values that occur
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    return np.unique(np.array([*cuts, most], np.int64))


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 3) characters replaced by as many of the next document's first; next is
    by descending id, and the first follows the last."""
    bounds = _ranges(docs, id_col)
    n_ranges = len(bounds)

    @F.pandas_udf("array<struct<part:int,follows:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        keys = keys.to_numpy(np.int64)
        own = np.searchsorted(bounds, keys)
        first = bounds[np.minimum(own, n_ranges - 1)] == keys
        return pd.Series([[{"part": p, "follows": False}] + ([{"part": (p + 1) % n_ranges, "follows": True}] if f else []) for p, f in zip(own.tolist(), first.tolist())])

    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(doc_id, F.lit(-(1 << 63)))
    rows = docs.select(doc_id.alias("doc_id"), key.alias("key"), text.alias("text"))
    dealt = rows.withColumn("p", F.explode(places("key"))).select("p.part", "p.follows", "doc_id", "key", "text")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "follows", F.desc("key"), F.xxhash64("text"), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document whose successor comes next
        done_part = None  # the range whose last document has met its successor
        for batch in batches:
            out = []
            for part, follows, doc_id, text in zip(batch["part"], batch["follows"], batch["doc_id"], batch["text"]):
                if follows and done_part == part:
                    continue
                codes = _codes(text)
                steps = walk(codes)
                own = (part, doc_id, text, codes, steps, _read(codes, steps))
                if held is not None:
                    _, h_id, h_text, h_codes, h_steps, h_print = held
                    edited, edited_print = _edited(h_text, h_codes, h_steps, text)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((h_id, len(h_codes), digest, h_print, edited_print, likeness(h_print, edited_print), likeness(h_print, own[5])))
                held = None if follows else own
                done_part = part if follows else None
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield frame.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": float, "near_next": float})

    return ordered.select("part", "follows", "doc_id", "text").mapInPandas(compare, ROW)


@lru_cache(1)
def _band_choice() -> np.ndarray:
    """For each band, digits to take of the four doublings before the last one that a text reaches."""
    return np.sort(np.random.default_rng(SEED + 2).integers(0, 4 * SAMPLES, (BANDS, BAND_DIGITS)), axis=1)


def band_keys(print_: str) -> list[str]:
    """The bands of a fingerprint: of its last whole doubling, and of the one before if it reaches less than half of the
    next, for texts a fifth shorter may end there."""
    last = len(print_) // SAMPLES
    keys = []
    for top in {last, last - 1 if len(print_) % SAMPLES < SAMPLES // 2 else last}:
        digits = print_[max(0, top - 4) * SAMPLES : top * SAMPLES]
        if top < 1:
            keys.append(f"0:{print_}")
        else:
            keys += [f"{top}:{b}:" + "".join(digits[i % len(digits)] for i in chosen) for b, chosen in enumerate(_band_choice())]
    return keys


def _links(prints: list[str], near: float, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints, of different blocks if there are two, whose likeness is at least near.

    A fingerprint meets one member of each cluster found so far; only the clusters that it does not join so are compared
    whole. A group of near copies takes time in proportion to its size, and no link between two clusters is lost."""
    octaves = max(1, -(-max(map(len, prints)) // SAMPLES))
    digits = np.zeros((len(prints), octaves * SAMPLES), np.uint8)
    size = np.array([len(p) for p in prints])
    for i, p in enumerate(prints):
        digits[i, : len(p)] = np.frombuffer(p.encode(), np.uint8)
    weights = _sample_weights()[: octaves * SAMPLES]
    whole, of_octave = np.concatenate([[0.0], np.cumsum(weights)]), weights[::SAMPLES]
    two, cluster = block.min() != block.max(), np.arange(len(prints))
    left, right = [], []

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        same = (digits[others] == digits[i]) & (digits[others] > 0)
        agree = same.reshape(-1, SAMPLES).sum(1, dtype=np.uint8).reshape(len(others), octaves) @ of_octave
        return (agree / np.maximum(whole[np.maximum(size[others], size[i])], 1e-9) - 1 / 16) / (1 - 1 / 16) >= near

    for i in range(1, len(prints)):
        others = np.flatnonzero(block[:i] != block[i]) if two else np.arange(i)
        found, first = np.unique(cluster[others], return_index=True)
        if not len(found):
            continue
        hit = alike(i, others[first])
        links = others[first[hit]]
        rest = np.delete(others, first)
        rest = rest[np.isin(cluster[rest], found[~hit])]
        if len(rest):
            more = rest[alike(i, rest)]
            links = np.concatenate([links, more])
        if len(links):
            left.append(np.full(len(links), i))
            right.append(links)
            joined = np.isin(cluster, cluster[np.append(links, i)])
            cluster[joined] = cluster[joined].min()
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def near_duplicates(prints: DataFrame, *, near: float = NEAR, id_col: str = "doc_id", print_col: str = "fingerprint", block: int = BLOCK) -> DataFrame:
    """prints with class_id: documents that share a band and whose likeness is at least near are linked; class_id is the
    least id of the class.

    Equal fingerprints are one member. Fingerprints go only to bands that two members share; a large band is dealt into
    pairs of blocks, so all its members are compared and no task holds more than two blocks. Rows without an id link to
    equal fingerprints only."""
    names = [c for c in prints.columns if c != "class_id"]
    rows = prints.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{print_col}`").alias("print"))
    members = cut(rows.groupBy("print").agg(F.min("doc_id").alias("member")), "edits-members")

    @F.pandas_udf("array<string>")
    def bands(column: pd.Series) -> pd.Series:
        return pd.Series([band_keys(p) for p in column])

    banded = members.where("member is not null").select("member", F.explode(F.array_distinct(F.transform(bands("print"), lambda k: F.xxhash64(k)))).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(banded.join(shared, "band"), "edits-met").join(members, "member")  # only bands that two share

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["band", "lo", "hi"]):
            ids = group["member"].to_numpy()
            row, root = stars(ids, *_links(group["print"].tolist(), near, group["block"].to_numpy()))
            if len(row):
                yield pd.DataFrame({"a": ids[row], "b": ids[root]})

    compared = dealt(met, "band", "member", "n", block).select("band", "lo", "hi", "block", "member", "print")
    links = cut(compared.mapInPandas(compare, "a long, b long"), "edits-links")
    classes = connected_components(links).toDF("member", "class_id")
    named = members.join(classes, "member", "left").select("print", F.coalesce("class_id", "member").alias("class_id"))
    return prints.select(whole_row(prints), F.col(f"`{print_col}`").alias("print")).join(named, "print").select(*[F.col("row").getField(c).alias(c) for c in names], "class_id")
