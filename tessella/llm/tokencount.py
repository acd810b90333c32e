"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge document (over `chunk` characters) is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a position of their overlap that is proven stable: the character before it is a space that no token, normal
form or special token can reach across (SAFE_SPACE), a token starts there in both encodings, and both encodings agree on
the ids of the word before it. If an overlap has no such position it is doubled, into the left chunk and beyond it where
needed, up to encoding the rest as one chunk; no token is ever guessed.

All other documents are one chunk. A chunk that need not be spliced is cut at the same proven positions into words, and
equal words are encoded once. Proof that this gives the whole text's ids: the pre-tokenizer ends a word at every white
space and drops it, the normalizer neither joins nor moves characters across a space between two characters of the
pattern, and merges happen within a word; so the encoding of a text is that of its words one after the other.

Chunks and words of Latin letters without special tokens are encoded by the file's ranks (bpe.WordEnds), with the same ids
and places as the library's, which encodes all others.

Defined cases: null text is empty: 0 bytes, 0 tokens; a text of any length is counted whole, one without a safe space as
one chunk; repeated rows are counted one by one, so there are no ties; an empty table gives no rows; columns other than
the two named ones, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import SAFE_SPACE, WordCache, tokenizer, vocabulary, word_ends

VOCABULARY = "word_bpe_49k.json"
CHUNK = 16384
OVERLAP = 512
LIMIT = 2048
_SPLIT = re.compile(SAFE_SPACE)
_CACHES: dict[str, WordCache] = {}


def encode_chunk(text: str, start: int, end: int, path: str) -> tuple[list[int], list[int]]:
    """ids of text[start:end] and where in the text each begins."""
    part, ranks = text[start:end], word_ends(path)
    got = ranks.encode(part) if ranks is not None and ranks.takes(part) else None
    if got is None:
        whole = tokenizer(path).encode(part, add_special_tokens=False)
        got = whole.ids, [a for a, _ in whole.offsets]
    return got[0], [start + a for a in got[1]]


def stable_boundary(text: str, left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], start: int, end: int) -> int | None:
    """A position in the overlap [start, end) at which both encodings may be cut, nearest to its middle; None if there is none."""
    safe = [m.end() for m in _SPLIT.finditer(text, start, min(end + 1, len(text))) if m.end() < end]
    middle = (start + end) // 2
    for k in sorted(range(1, len(safe)), key=lambda k: abs(safe[k] - middle)):
        before, at = safe[k - 1], safe[k]
        cuts = []
        for ids, places in (left, right):
            i, j = bisect_left(places, before), bisect_left(places, at)
            if i < j < len(places) and places[i] == before and places[j] == at:
                cuts.append(ids[i:j])
        if len(cuts) == 2 and cuts[0] == cuts[1]:
            return at
    return None


def encode_spliced(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], dict[str, int]]:
    """ids of a whole text from overlapping chunks, and how often chunks were spliced and overlaps widened."""
    seen = {"chunks": 1, "spliced": 0, "widened": 0}
    start, end = 0, min(chunk, len(text))
    left, taken, out = encode_chunk(text, start, end, path), 0, []
    while end < len(text):
        width, more = overlap, chunk
        while True:
            begin, finish = max(taken, end - width), min(len(text), end + more)
            right = encode_chunk(text, begin, finish, path)
            seen["chunks"] += 1
            at = stable_boundary(text, left, right, begin, end)
            if at is not None or begin == taken:
                break
            seen["widened"] += 1
            width *= 2
        if at is None:
            # the overlap is all that is not spliced yet: encode it with the next chunk as one
            left, end = right, finish
            continue
        i = bisect_left(left[1], at)
        out += left[0][:i]
        j = bisect_left(right[1], at)
        left = (right[0][j:], right[1][j:])
        seen["spliced"] += 1
        taken, end = at, finish
    return out + left[0], seen


def _count_words(words: list[str], path: str) -> list[int]:
    """Tokens of words: by ranks, those with other characters or special tokens by the library."""
    ranks, out = word_ends(path), []
    if ranks is None:
        return _count_by_library(words, path)
    for k in range(0, len(words), 4096):
        some = words[k : k + 4096]
        plain = [True] * len(some) if ranks.takes(" ".join(some)) else [ranks.takes(w) for w in some]
        counts = ranks.counts([w for w, p in zip(some, plain) if p])
        if counts is None:
            out += _count_by_library(some, path)
            continue
        by_ranks, others = iter(counts), iter(_count_by_library([w for w, p in zip(some, plain) if not p], path))
        out += [next(by_ranks if p else others) for p in plain]
    return out


def _count_by_library(words: list[str], path: str) -> list[int]:
    """Tokens of words, many encoded as one text with spaces between and told apart by the tokens' offsets."""
    out: list[int] = []
    for k in range(0, len(words), 4096):
        some = words[k : k + 4096]
        lengths = np.array([len(w) + 1 for w in some])
        ends = np.cumsum(lengths)
        places = np.array(tokenizer(path).encode(" ".join(some), add_special_tokens=False).offsets, np.int64).reshape(-1, 2)[:, 0]
        out += np.bincount(np.searchsorted(ends, places, side="right"), minlength=len(some)).tolist()
    return out


def count_tokens(texts: list[str | None], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    cache = _CACHES.setdefault(path, WordCache())
    out: list[int] = []
    for k in range(0, len(texts), 512):
        some = [t or "" for t in texts[k : k + 512]]
        parts = [_SPLIT.split(t) if len(t) <= chunk else None for t in some]
        get = cache.known(set().union(*(p for p in parts if p)), lambda new: _count_words(new, path)).__getitem__
        out += [sum(map(get, p)) if p is not None else len(encode_spliced(t, path, chunk, overlap)[0]) for p, t in zip(parts, some)]
    return out


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""
    where = path or vocabulary(VOCABULARY)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(texts.tolist(), where, chunk, overlap), dtype="int64")

    text = F.col(f"`{text_col}`")
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
