import random

import numpy as np
import xxhash

from tessella.llm import simhash
from tessella.llm.components import connected_components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, bits=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_code_has_distance_24():
    half = simhash.anchors()
    assert len(half) == 1 << 15
    weights = np.bitwise_count(half[1:])
    assert half[0] == 0 and weights.min() == 24 and weights.max() == 40


def test_fingerprints_by_definition():
    texts = [None, "", "One", "one TWO", "a b c", "a  b\tc\x0bd\u00a0e f", "Ä b c ä", "x y z " * 5000, "w " * 100]
    texts += [" ".join(random.Random(i).choices("ab cd ef gh ij kl mn".split(), k=i)) for i in range(40)]
    assert [int(x) for x in simhash.fingerprints(texts)] == [plain_fingerprint(t) for t in texts]


def test_native_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("one two thrée",)], "s string").select(F.xxhash64("s")).first()
    assert row[0] % (1 << 64) == xxhash.xxh64_intdigest("one two thrée".encode(), 42)


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(120):
        centre = rng.getrandbits(64)
        fps.append(centre)
        for _ in range(rng.choice([0, 1, 5])):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for block in (2048, 4):  # small blocks: every anchor is dealt into pairs of blocks
        links = connected_components(simhash.link_fingerprints(df, block=block)).collect()
        root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in links}
        got, want = {}, {}
        for x, w in zip(fps, plain_components(fps)):
            got.setdefault(root.get(x, x), set()).add(x)
            want.setdefault(w, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, docs):
    rng = random.Random(1)
    base = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(12)]
    near = [b.replace(b.split()[40], "changed", 1) for b in base]
    texts = base + near + base[:3] + [None, "", " \t", "short"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(*texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_components(fps)
    assert got[28]["component_id"] == got[27]["component_id"] == 27


def test_empty_repeated_and_null_id(spark, docs):
    assert simhash.near_duplicates(docs().where("false")).collect() == []
    rows = docs((3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "x y z"))
    got = simhash.near_duplicates(rows).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    kept = simhash.deduplicate(rows)
    assert kept.columns == rows.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("3", "a b c d"), ("None", "x y z")]


def test_each_component_keeps_a_row(spark, docs):
    rows = docs((None, "a b c d"), (None, "x y z"), (None, "x y z"), (3, "one two three four"), (3, "five six seven eight"), (3, "five six seven eight"), (4, "one two three four"))
    kept = simhash.deduplicate(rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("3", "five six seven eight"), ("3", "one two three four"), ("None", "a b c d"), ("None", "x y z")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert connected_components(edges.where("false")).collect() == []
