"""Language-model scores of whole texts: a smoothed word unigram, and the subword lattice likelihood.

The corpus gives a table of word counts. The lattice model weights the pieces of an existing vocabulary: one round of
expectation maximisation, started from the file's own scores, shares every counted word among all its segmentations.
A document's score is the log of the summed probability of all segmentations of all its words, and of the end.

The model has as many numbers as the vocabulary has pieces and is sent to all workers. The word counts grow with the
corpus and are not: only words of at most `word_bytes` bytes whose count is so high that at most `frequent` words
reach it are sent along, with their scores. A text's other words are joined with the table of words.

Defined cases: null text is empty: one token, the end. Without training texts every token has base probability 1 (the
formula's value) and the pieces keep the file's scores. Repeated rows are scored, and counted, one by one. A text of any
length is scored whole; a word of any length too, block by block, with a number for each character held. Of words that tie
in count all or none are sent along. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bpe import vocabulary
from tessella.llm.common import cut, drop_cut
from tessella.llm.lattice import MARK, SHORT, Lattices, expected_counts, load, log_marginal, rank_weights, shown

VOCABULARY = "piece_bpe_32k.model"
FREQUENT = 400_000
WORD_BYTES = 48
SMOOTHING = 0.1
FLUSH = 200_000
BUCKETS = 8  # a doubling of the count


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower() changes A-Z only and bytes.split() splits at \x20 and \x09-\x0D only
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, *, text_col: str = "text", learn_col: str = "learn") -> DataFrame:
    """(word binary, n long): every word of docs and how often it stands in the rows to learn from; partitions count before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text, learn in zip(batch["text"], batch["learn"]):
                held.update(words_of(text) if learn else dict.fromkeys(words_of(text), 0))
                if len(held) > FLUSH:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    counted = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{learn_col}`").alias("learn")).mapInPandas(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def unit_of(word: bytes) -> str:
    return MARK + shown(word.decode())


def _units(words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words' units, and which of them are short and which long."""
    found = [unit_of(w) for w in words]
    short = np.array([len(u) <= SHORT for u in found], bool)
    return found, np.flatnonzero(short), np.flatnonzero(~short)


def train_pieces(counts: DataFrame, ends: int, path: str) -> tuple[np.ndarray, float]:
    """(probability by id, probability of the end)."""
    start = np.exp(rank_weights(load(path)))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        total = np.zeros(model.size)
        for batch in batches:
            n = batch["n"].to_numpy(float)
            found, short, long = _units(batch["word"].tolist())
            if len(short):
                total += Lattices([found[i] for i in short], path, start).expectations(n[short], model.size, model)
            for i in long:
                expected_counts(found[i], n[i], path, start, total)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "x": total[used]})

    model = load(path)
    got = counts.where("n > 0").mapInPandas(expect, "id int, x double").groupBy("id").agg(F.sum("x").alias("x")).toPandas()  # a row a piece
    total = np.where(start > 0, SMOOTHING, 0.0)
    total[got["id"].to_numpy()] += got["x"].to_numpy()
    z = total.sum() + ends + SMOOTHING
    if not len(got) and not ends:
        end = SMOOTHING / (SMOOTHING + 1)
        return start * (1 - end), end
    return total / z, (ends + SMOOTHING) / z


def word_scores(counts: DataFrame, prob: np.ndarray, path: str) -> DataFrame:
    """counts with m, each word's log10 probability summed over its segmentations."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, short, long = _units(batch["word"].tolist())
            m = np.zeros(len(found))
            if len(short):
                m[short] = Lattices([found[i] for i in short], path, prob).marginals()
            for i in long:
                m[i] = log_marginal(found[i], path, prob)
            yield batch.assign(m=m / math.log(10))

    return counts.mapInPandas(score, "word binary, n long, m double")


def _frequent(words: DataFrame, most: int, word_bytes: int) -> pd.DataFrame:
    """The words, of bounded length, whose count reaches a bucket that at most `most` words reach."""
    bucket = F.floor(F.log2(F.col("n") + 1) * BUCKETS).cast("int")
    short = words.where(F.octet_length("word") <= word_bytes).withColumn("bucket", bucket)
    sizes = sorted(((r["bucket"], r["k"]) for r in short.groupBy("bucket").agg(F.count("*").alias("k")).collect()), reverse=True)  # 8 rows a doubling
    reached, lowest = 0, None
    for b, k in sizes:
        if reached + k > most:
            break
        reached, lowest = reached + k, b
    if lowest is None:
        return pd.DataFrame({"word": [], "n": [], "m": []})
    return short.where(F.col("bucket") >= lowest).select("word", "n", "m").toPandas()


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", learn_col: str = "learn", path: str | None = None, frequent: int = FREQUENT, word_bytes: int = WORD_BYTES) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from the rows with learn_col."""
    path = path or vocabulary(VOCABULARY)
    counts = cut(word_counts(docs, text_col=text_col, learn_col=learn_col), "lm-counts")
    ends = docs.where(F.col(f"`{learn_col}`")).count()
    whole = counts.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long")), F.count("*")).first()
    n_train, distinct, n_words = (whole[0] or 0) + ends, (whole[1] or 0) + (ends > 0), whole[2]
    scale = math.log10(n_train + 0.5 * (distinct + 1))
    prob, end = train_pieces(counts, ends, path)
    words = cut(word_scores(counts, prob, path), "lm-words")
    drop_cut(counts)
    top = _frequent(words, frequent, word_bytes)
    known = {bytes(w): (math.log10(n + 0.5) - scale, m, n > 0) for w, n, m in zip(top["word"], top["n"], top["m"])}
    sent = docs.sparkSession.sparkContext.broadcast(known)
    end_base, end_score = math.log10(ends + 0.5) - scale, math.log10(end)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = sent.value.get
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, lattice, seen, rare, times = end_base, end_score, int(ends > 0), [], []
                tokens = words_of(text)
                for word, n in Counter(tokens).items():
                    hit = get(word)
                    if hit is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        base += n * hit[0]
                        lattice += n * hit[1]
                        seen += n * hit[2]
                rows.append((uid, doc_id, len(tokens) + 1, seen, base, lattice, rare, times))
                uid += 1
            frame = pd.DataFrame(rows, columns=["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "words", "times"])
            yield frame.astype({"doc_id": "Int64"})

    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(
        score, "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<int>"
    )
    train_tokens = F.lit(n_train).cast("long").alias("train_tokens")
    if len(top) == n_words:  # every word went along: none is left to be joined
        return scored.select("doc_id", "n_tokens", "n_known", train_tokens, "base_score", "score")
    scored = cut(scored, "lm-scored")
    rare = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(words, "word")
    more = met.groupBy("uid").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(scale))).alias("base"), F.sum(F.col("times") * F.col("m")).alias("lattice"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found")
    )
    full = scored.select("uid", "doc_id", "n_tokens", "n_known", "base_score", "score").join(more, "uid", "left")
    add = lambda c, extra, none: (F.col(c) + F.coalesce(extra, F.lit(none))).alias(c)
    return full.select("doc_id", "n_tokens", add("n_known", "found", 0), train_tokens, add("base_score", "base", 0.0), add("score", "lattice", 0.0))
