import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid

SAMPLE = {"en": "the quick brown fox thinks that this is there", "de": "der schnelle braune fuchs denkt dass dies hier ist", "fr": "le renard brun pense que ceci est là où il était", "es": "el zorro marrón piensa que esto está allí señor"}


def labelled(spark, n=30):
    import random

    rng = random.Random(1)
    rows = [(lang, " ".join(rng.choices(text.split(), k=12))) for lang, text in SAMPLE.items() for _ in range(n)]
    return spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, score string")


def test_codewords_are_apart():
    for n in (2, 4, 7, 12, 40):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= 1 if n == 2 else min(apart) >= code.shape[1] // 4
        assert np.isin(code, (-1, 1)).all()


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    model = langid.train(rows.where("doc_id % 3 <> 1"))
    got = langid.identify(rows.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_counts_are_of_whole_texts():
    text = "abc déf " * 10
    total = langid.gram_counts(text)
    assert total.sum() == 3 * (len(text) + 2) - 3
    longer = "x" * (langid.PIECE + 5)
    assert langid.gram_counts(longer).sum() == 3 * (len(longer) + 4) - 6


def plain_decoding(text, counts):
    """The definition, number by number: margins of every bit, logistic losses, softmax, mean margin."""
    import math

    softplus = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) for k in langs}
    share = {k: [(counts[k].get(g, 0) + langid.ALPHA) / (total[k] + langid.ALPHA * langid.DIMS) for g in range(langid.DIMS)] for k in langs}
    bits = [[1 if (mask >> i) & 1 else -1 for i in range(len(langs))] for mask in range(1, 1 << (len(langs) - 1))]
    weights = []
    for bit in bits:
        ones, zeros = ([k for k, c in zip(langs, bit) if c == sign] for sign in (1, -1))
        weights.append([math.log(sum(share[k][g] for k in ones) / len(ones)) - math.log(sum(share[k][g] for k in zeros) / len(zeros)) for g in range(langid.DIMS)])
    grams = langid.gram_hashes(text).tolist()
    loss, near = [], []
    for i, k in enumerate(langs):
        clear = [max(1e-6, bit[i] * sum(s * w for s, w in zip(share[k], weight))) for bit, weight in zip(bits, weights)]
        near.append([bit[i] * sum(weight[g] for g in grams) / len(grams) / c for bit, weight, c in zip(bits, weights, clear)])
        loss.append(sum(c * len(bits) / sum(clear) * softplus(-langid.SHARPNESS * r) for r, c in zip(near[i], clear)))
    p = [math.exp(-x) / sum(math.exp(-y) for y in loss) for x in loss]
    order = sorted(range(len(langs)), key=lambda i: (-p[i], i))
    best = order[0]
    return langs[best], p[best] * sum(min(1, max(0, r)) for r in near[best]) / len(bits), langs[order[1]], p[best] - p[order[1]] < langid.MARGIN


def test_decoding_is_the_definition(spark):
    rows = labelled(spark, 6)
    counts = {}
    for r in rows.collect():
        for g in langid.gram_hashes(r["text"]).tolist():
            counts.setdefault(r["lang"], {}).setdefault(g, 0)
            counts[r["lang"]][g] += 1
    texts = [SAMPLE["de"], "the fox thinks", "le renard pense the quick fox is there", "q", "xxxx yyyy zzzz 123", "der", SAMPLE["en"] + " " + SAMPLE["es"]]
    got = langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), langid.train(rows)).collect()
    for r in got:
        lang, score, second, ambiguous = plain_decoding(r["text"], counts)
        assert (r["lang_pred"], r["runner_up"], r["ambiguous"]) == (lang, second, ambiguous), r
        assert abs(r["score"] - score) < 1e-4


def test_mixtures_are_ambiguous_and_junk_scores_low(spark):
    model = langid.train(labelled(spark))
    pure = [t for t in SAMPLE.values()]
    # as many characters of each
    mixed = [f"{(SAMPLE[a] + ' ') * len(SAMPLE[b])}{(SAMPLE[b] + ' ') * len(SAMPLE[a])}" for a in SAMPLE for b in SAMPLE if a < b]
    junk = ["xkqz wvjx qqzk zzxw", "token = 7f3a9c 00ff12 b7b7b7", "$$$ ### x %%% &&&"]
    rows = spark.createDataFrame([(k, t) for k, ts in (("pure", pure), ("mixed", mixed), ("junk", junk)) for t in ts], "kind string, text string")
    got = langid.identify(rows, model).collect()
    assert all(r["score"] > 0.8 and not r["ambiguous"] for r in got if r["kind"] == "pure")
    mixtures = [r for r in got if r["kind"] == "mixed"]
    assert sum(r["ambiguous"] for r in mixtures) >= 2
    assert max(r["score"] for r in mixtures) < min(r["score"] for r in got if r["kind"] == "pure")
    assert all(r["score"] < 0.6 for r in got if r["kind"] == "junk")


def test_odd_texts(spark):
    model = langid.train(labelled(spark))
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "123 !"), (3, "der fuchs denkt " * 50_000), (4, "q")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "de"]
    assert got[0]["score"] == 0 and got[4]["lang_pred"] in SAMPLE
    assert langid.identify(rows.where("false"), model).collect() == []


@pytest.mark.parametrize("keep", ["false", "lang = 'en'", "lang in ('en', 'de')"])
def test_few_languages(spark, keep):
    rows = labelled(spark)
    model = langid.train(rows.where(keep))
    told = {r["lang_pred"] for r in langid.identify(rows, model).collect()}
    assert told == ({"und"} if keep == "false" else set(model.langs))


def test_labels_without_text_and_texts_without_label_teach_nothing(spark):
    rows = labelled(spark).select("text", "lang")
    more = spark.createDataFrame([(None, "xx"), ("some text", None)], "text string, lang string")
    assert langid.train(rows.union(more)).langs == sorted(SAMPLE)
    assert np.array_equal(langid.train(rows).weights, langid.train(rows.union(more)).weights)


def test_query_rule(spark):
    from tessella.llm.common import id_remainder
    import zlib

    got = {r[0]: r[1] for r in spark.range(50).select("id", id_remainder(F.col("id"), 3)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
