import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import lattice, lmscore, sampling
from tessella.llm.bpe import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "the tion thing", "▁ raw ▁mark", "퟿ é 😀 日本 \x00\n\t", "x" * 300, "￾ ￿ odd", "a ▁ b", "Ünïcode here", "the " * 50]


@pytest.fixture(scope="module")
def model():
    return lattice.load(PATH)


def segmentations(unit, model):
    """All of them, by their definition: pieces of the vocabulary, and the bytes of a character that is none."""
    if not unit:
        return [()]
    out = []
    for k in range(1, len(unit) + 1):
        if unit[:k] in model.pieces:
            out += [(model.pieces[unit[:k]], *rest) for rest in segmentations(unit[k:], model)]
        elif k == 1:
            raw = (lattice.MARK if unit[0] == lattice.RAW_MARK else unit[0]).encode()
            out += [(*(model.byte_ids[b] for b in raw), *rest) for rest in segmentations(unit[1:], model)]
    return out


def test_marginal_and_expectations_by_enumeration(model):
    prob = np.exp(lattice.rank_weights(model))
    for unit in ("▁the", "▁thing", "ab", "▁é😀", "▁", "▁tion,"):
        paths = segmentations(unit, model)
        weight = [math.prod(prob[i] for i in p) for p in paths]
        assert lattice.log_marginal(unit, PATH, prob) == pytest.approx(math.log(sum(weight)))
        into = np.zeros(model.size)
        lattice.expected_counts(unit, 2.0, PATH, prob, into)
        want = Counter()
        for p, w in zip(paths, weight):
            for i in p:
                want[i] += 2 * w / sum(weight)
        assert {i: pytest.approx(x) for i, x in enumerate(into) if x} == dict(want)


def test_long_units_do_not_underflow(model):
    prob = np.exp(lattice.rank_weights(model))
    unit = "▁" + "zq" * 400
    assert -1e5 < lattice.log_marginal(unit, PATH, prob) < -100
    into = np.zeros(model.size)
    lattice.expected_counts(unit, 1.0, PATH, prob, into)
    assert 100 < into.sum() < 801


def test_sampling_follows_the_lattice(model):
    prob = np.exp(lattice.rank_weights(model))
    paths = segmentations("▁tion", model)
    weight = np.array([math.prod(prob[i] for i in p) for p in paths])
    n = 20_000
    got = sampling.sample(np.arange(n), [" tion"] * n, PATH, prob, 1)
    seen = Counter(tuple(g.tolist()) for g in got)
    assert set(seen) <= set(paths)
    for p, w in zip(paths, weight / weight.sum()):
        assert seen[p] / n == pytest.approx(w, abs=0.02)


def test_many_units_at_once_are_as_one_by_one(model):
    prob = np.exp(lattice.rank_weights(model))
    rng = random.Random(7)
    units = ["▁", "▁the", "é", "日本x", "▁😀é😀", lattice.RAW_MARK + "a"] + ["▁" + "".join(rng.choices("tionabé日\n", k=rng.randint(0, 20))) for _ in range(300)]
    many = lattice.Lattices(units, PATH, prob)
    assert many.marginals() == pytest.approx([lattice.log_marginal(u, PATH, prob) for u in units])
    times = np.arange(len(units)) + 0.5
    want = np.zeros(model.size)
    for u, n in zip(units, times):
        lattice.expected_counts(u, n, PATH, prob, want)
    assert many.expectations(times, model.size, model) == pytest.approx(want)
    assert lattice.Lattices([], PATH, prob).marginals().tolist() == []


UNCOVERED = ["\U00012000" * 20, "\U00013000" * 31, "ཀྵ྅ྊ" * 6, "\U00012000" * 25 + "tion", "ꀀ" * 28]


def test_units_in_bytes_do_not_underflow(model):
    prob = np.exp(lattice.rank_weights(model))
    units = [lattice.MARK + w for w in UNCOVERED] + ["▁the"]
    assert all(len(u) <= lattice.SHORT for u in units)
    many = lattice.Lattices(units, PATH, prob)
    assert many.marginals() == pytest.approx([lattice.log_marginal(u, PATH, prob) for u in units])
    want = np.zeros(model.size)
    for u in units:
        lattice.expected_counts(u, 3.0, PATH, prob, want)
    assert many.expectations(np.full(len(units), 3.0), model.size, model) == pytest.approx(want)


def test_sampling_behind_many_bytes_follows_the_lattice(model):
    prob = np.exp(lattice.rank_weights(model))
    n = 5000
    head, tail = "\U00012000" * 25, "tion"
    long = [[b for i in x.tolist() for b in (lattice.byte_pieces(i, model) if i < 0 else [i])] for x in lattice.LongUnit(head + tail, PATH, prob).sample(np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), sampling._uniforms)]
    want, got = Counter(tuple(x[100:]) for x in long), Counter(tuple(g.tolist()[100:]) for g in sampling.sample(np.arange(n), [head + tail] * n, PATH, prob, 1))
    assert len(want) > 1
    for path in want | got:
        assert got[path] / n == pytest.approx(want[path] / n, abs=0.04)


def test_long_units_block_by_block_are_as_whole(model):
    prob = np.exp(lattice.rank_weights(model))
    rng = random.Random(17)
    unit = "▁" + "".join(rng.choices("tionabéthe日\U00012000", k=31))
    many = lattice.Lattices([unit], PATH, prob)
    want = many.expectations(np.array([2.0]), model.size, model)
    for block in (1, 5, 1000):
        long = lattice.LongUnit(unit, PATH, prob, block)
        assert long.forward()[-1] == pytest.approx(many.marginals()[0])
        into = np.zeros(model.size)
        long.expectations(2.0, into)
        assert into == pytest.approx(want)
    # pieces of a long unit come with the same probabilities whatever the block: count them
    n = 400
    streams = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = lattice.LongUnit("tion" * 50, PATH, prob).sample(streams, sampling._uniforms)
    parts = lattice.LongUnit("tion" * 50, PATH, prob, 7).sample(streams, sampling._uniforms)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_very_long_units(model):
    prob = np.exp(lattice.rank_weights(model))
    text = "".join(random.Random(3).choices("abc日é\n", k=300_000))
    got = sampling.sample(np.array([7]), [text], PATH, prob, 1)[0]
    assert sampling.decode(got.tolist(), model) == text
    assert -1e7 < lattice.log_marginal(text, PATH, prob) < -1e5


def test_common_units_change_nothing(model, monkeypatch):
    prob = np.exp(lattice.rank_weights(model))
    rng = random.Random(5)
    words = ["".join(rng.choices("tionabé", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    keys = np.arange(40)
    want = sampling.sample(keys, texts, PATH, prob, 77)
    monkeypatch.setattr(sampling, "COMMON_AFTER", 1000)
    monkeypatch.setattr(sampling, "COMMON_UNITS", 30)
    sampling._common.clear()
    sampling._seen.clear()
    got = [g for k in range(0, 40, 5) for g in sampling.sample(keys[k : k + 5], texts[k : k + 5], PATH, prob, 77)]
    assert len(sampling._common) == 1 and all(np.array_equal(a, b) for a, b in zip(want, got))
    sampling._common.clear()


def test_scores_of_words_in_bytes(spark, model):
    texts = ["the " + w for w in UNCOVERED] + ["on the tion", *UNCOVERED]
    learn = [i < 4 or i == 5 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean")
    prob, end = lmscore.train_pieces(lmscore.word_counts(rows), sum(learn), PATH)
    assert np.isfinite(prob).all() and sum(prob) + end == pytest.approx(1)
    got = {r["doc_id"]: r["score"] for r in lmscore.score_texts(rows).collect()}
    for i, t in enumerate(texts):
        want = math.log10(end) + sum(lattice.log_marginal(lmscore.unit_of(w), PATH, prob) for w in lmscore.words_of(t)) / math.log(10)
        assert math.isfinite(got[i]) and got[i] == pytest.approx(want)


def test_lossless_and_reproducible(model):
    prob = np.exp(lattice.rank_weights(model))
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices("ab ▁é\n日", k=50)) for _ in range(100)]
    keys = np.arange(len(texts))
    once = sampling.sample(keys, texts, PATH, prob, 5)
    assert [sampling.decode(g.tolist(), model) for g in once] == texts
    for i in (3, 8, 50):
        alone = sampling.sample(keys[i : i + 1], texts[i : i + 1], PATH, prob, 5)
        assert np.array_equal(alone[0], once[i])
    other = sampling.sample(keys + 1000, texts, PATH, prob, 5)
    assert any(not np.array_equal(a, b) for a, b in zip(once, other))


def test_query(spark, docs):
    rows = docs(*[(i, t) for i, t in enumerate(t for t in TEXTS if "\ud800" not in t)], (99, None), (None, "x"))
    got = sampling.sampled_pieces(rows)
    seen = {r["doc_id"]: r for r in got.collect()}
    assert all(r["lossless"] for i, r in seen.items() if i != 99) and seen[99]["piece_ids"] is None
    assert seen[3]["ids_crc32"] == zlib.crc32(np.array(seen[3]["piece_ids"], "<u4").tobytes())
    again = {r["doc_id"]: r for r in sampling.sampled_pieces(rows.repartition(3)).collect()}
    assert seen == again
    back = {r["doc_id"]: r["text"] for r in sampling.decoded(got).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert sampling.sampled_pieces(rows.where("false")).collect() == []


def plain_scores(texts, learn, prob, end, model):
    train = [w for t, k in zip(texts, learn) if k for w in [*(t or "").encode().lower().split(), None]]
    count, n = Counter(train), len(train)
    v = len(count)
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        tokens = [*words, None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        score = math.log10(end) + sum(math.log10(sum(math.prod(prob[i] for i in p) for p in segmentations(lmscore.unit_of(w), model))) for w in words)
        out.append((len(tokens), sum(count[w] > 0 for w in tokens), n, base, score))
    return out


def test_scores_against_brute_force(spark, model):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["The", "tion", "é", "Zq", "ab c", "▁m", "on"], k=rng.randint(0, 9))) for _ in range(30)] + [None, ""]
    texts += ["unseen words here"]
    learn = [i % 3 != 0 and i < 32 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, t, k, "clash") for i, (t, k) in enumerate(zip(texts, learn))], "doc_id long, text string, learn boolean, words string")
    counts = lmscore.word_counts(rows)
    prob, end = lmscore.train_pieces(counts, sum(learn), PATH)
    assert sum(prob) + end == pytest.approx(1)
    want = plain_scores(texts, learn, prob, end, model)
    for frequent in (400_000, 3, 0):  # all words sent along, some, none
        got = {r["doc_id"]: r for r in lmscore.score_texts(rows, frequent=frequent).collect()}
        for i, (n_tokens, n_known, n, base, score) in enumerate(want):
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_no_training_text_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a b", False), (1, "a b", False), (None, None, False)], "doc_id long, text string, learn boolean")
    got = lmscore.score_texts(rows).collect()
    assert len(got) == 3 and all(r["base_score"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in got)
    assert lmscore.score_texts(rows.where("false")).collect() == []
