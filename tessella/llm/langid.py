"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary n-gram classifier tells the languages with a 1 from
those with a 0. The classifiers are log odds of hashed character 1- to 3-grams, learned from counts over every
training document. A text's margin on a bit is its grams' mean log odds, as a part of what that language's own texts
have on average: 1 for pure text, 0 for text of neither side, -1 for text of the other. Decoding takes, for each
codeword, the logistic loss of its margins, each bit weighted by how clearly it separates that language in training,
and chooses the least. The score is the softmax of the losses times the mean margin, so it is low both where two
codewords are about as near (a mixture, then the text is flagged ambiguous) and where none is near (junk).

What is held on the driver and sent to workers is n_langs x DIMS counts and DIMS x bits weights: it depends on the
number of languages (at most MAX_LANGS), not on the corpus.

Defined cases: null text, or text without a letter, is `und` with score 0; so is every text if nothing was learned.
Rows without a language or text teach nothing. Repeated rows count as often as they occur; ties go to the smaller
language name. With one language in training every text with a letter is that language, with score 1. Texts of any
length are read whole, 262,144 characters at a time. An empty table gives no rows. Other columns, whatever their names,
stay as they are, but for those that identify() names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import whole_row

DIMS = 1 << 15
MAX_LANGS = 256
ALPHA = 0.5
SHARPNESS = 2.0
MARGIN = 0.5  # a text is ambiguous if the second language's probability is nearer than this to the first's
PIECE = 1 << 18  # characters featurised at a time; longer texts are summed piece by piece
LETTER = re.compile(r"[^\W\d_]")
FIELDS = "lang_pred string, score double, runner_up string, ambiguous boolean"


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # langs x bits, +1 or -1
    weights: np.ndarray  # DIMS x bits
    trust: np.ndarray  # langs x bits, rows sum to the number of bits
    clear: np.ndarray  # langs x bits, mean margin of each language's own texts


def gram_hashes(text: str) -> np.ndarray:
    """Hashes in [0, DIMS) of the 1- to 3-grams of a whole lower-cased text with a space on either side."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    m = np.uint32(2654435761)
    one = c * m
    two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(31) + c[1:]
    three = (two[:-1] * np.uint32(0x85EBCA6B)) ^ c[2:]
    h = np.concatenate([one, two * m, three * m])
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(17)).astype(np.int32)


def gram_counts(text: str) -> np.ndarray:
    """Counts of a whole text's grams; texts over PIECE characters are summed piece by piece, so memory stays bounded."""
    total = np.zeros(DIMS, np.int64)
    for i in range(0, max(1, len(text)), PIECE):
        total += np.bincount(gram_hashes(text[i : i + PIECE]), minlength=DIMS)
    return total


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 a language: the exhaustive code up to seven languages, else a fixed dense random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if (mask >> i) & 1 else -1 for i in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(bits, float).T
    rng, width = np.random.default_rng(20), int(10 * np.log2(n)) + 1
    best, far = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart.min()
    return best


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of docs with text and language. One pass; partitions are counted before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            parts = [pd.DataFrame({"lang": k, "gram": np.flatnonzero(v), "n": v[np.flatnonzero(v)]}) for k, v in held.items()]
            held.clear()
            return pd.concat(parts)

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if lang not in held:
                    if len(held) >= 32:
                        yield rows()
                    held[lang] = np.zeros(DIMS, np.int64)
                held[lang] += gram_counts(text)
        if held:
            yield rows()

    known = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    counts = known.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    table = {r["lang"]: r["grams"] for r in got.limit(MAX_LANGS + 1).toLocalIterator()}
    if len(table) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(table)
    dense = np.zeros((len(langs), DIMS))
    for i, lang in enumerate(langs):
        pairs = np.array([(g["gram"], g["n"]) for g in table[lang]], np.int64)
        dense[i, pairs[:, 0]] = pairs[:, 1]
    return fit(langs, dense)


def fit(langs: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(langs))
    share = (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * DIMS) if len(langs) else counts
    if len(langs) < 2:
        return Model(langs, code, np.zeros((DIMS, code.shape[1]), np.float32), np.ones_like(code), np.ones_like(code))
    weights = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    clear = np.maximum(share @ weights * code, 1e-6)  # expected margin of each language's own texts
    return Model(langs, code, weights.astype(np.float32), clear / clear.sum(1, keepdims=True) * code.shape[1], clear)


def predict(texts: pd.Series, model: Model, margin: float) -> pd.DataFrame:
    out = []
    for text in texts:
        if text is None or not model.langs or not LETTER.search(text):
            out.append(("und", 0.0, None, True))
            continue
        total, n = np.zeros(model.code.shape[1]), 0
        for i in range(0, len(text), PIECE):
            h = gram_hashes(text[i : i + PIECE])
            total += model.weights.take(h, axis=0).sum(0, dtype=np.float64) if len(h) < 4096 else np.bincount(h, minlength=DIMS) @ model.weights
            n += len(h)
        near = model.code * (total / n) / model.clear
        loss = (np.logaddexp(0, -SHARPNESS * near) * model.trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        second = order[1] if len(order) > 1 else None
        gap = p[order[0]] - (p[second] if second is not None else 0.0)
        match = np.clip(near[order[0]], 0, 1).mean() if second is not None else 1.0
        out.append((model.langs[order[0]], float(p[order[0]] * match), model.langs[second] if second is not None else None, bool(gap < margin)))
    return pd.DataFrame(out, columns=["lang_pred", "score", "runner_up", "ambiguous"])


def predictor(model: Model, margin: float = MARGIN):
    """A column function of the text: struct<lang_pred, score, runner_up, ambiguous>."""

    @F.pandas_udf(FIELDS)
    def language(texts: pd.Series) -> pd.DataFrame:
        return predict(texts, model, margin)

    return language


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score, runner_up and ambiguous added, or in place of columns of these names."""
    told = docs.select(whole_row(docs), predictor(model, margin)(F.col(f"`{text_col}`")).alias("told"))
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "runner_up", "ambiguous")]
    return told.select(*[F.col("row").getField(c).alias(c) for c in names], "told.*")
