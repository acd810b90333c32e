import hashlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import identity, vectors
from tessella.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,want", [("a\r\nb\rc", "a\nb\nc"), ("a\0b", "ab"), (" \t a \t  b ", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("", "")]
)
def test_normalized(spark, raw, want):
    assert one(spark, T.normalized, raw) == want


def test_terms(spark):
    assert one(spark, T.rerank_terms, "Como funciona o Dijkstra, o algoritmo?") == ["funciona", "dijkstra", "algoritmo"]
    assert one(spark, T.adaptive_terms, "Compare Dijkstra e Bellman-Ford") == ["compare", "dijkstra", "bellman-ford"]
    assert one(spark, T.significant_terms, "Qual é a complexidade do x2 e da AVL?") == ["complexidade", "x2", "avl"]
    assert one(spark, T.named_terms, "Como Árvore AVL-2 e wesley em Wesley?") == ["Árvore", "AVL-2", "Wesley"]
    assert one(spark, T.protected_terms, "O tempo é O(n log n), 3.5 vezes, Heap e a[i].") == ["o n log n", "3 5", "heap", "a i"]


def test_claims_and_negation(spark):
    assert one(spark, T.claims, "Versão 2.0 existe. Ela tem X e possui Y; fim\nlinha") == ["Versão 2.0 existe.", "Ela tem X", "possui Y;", "fim", "linha"]
    assert one(spark, lambda x: T.claims(x, "en"), "It is fast and has no lock") == ["It is fast", "has no lock"]
    assert one(spark, T.is_negated, "isto não serve") and not one(spark, T.is_negated, "cenão serve")
    assert one(spark, lambda x: T.is_negated(x, "en"), "it is not so")


@pytest.mark.parametrize("size,want", [(0, 1), (4, 1), (5, 2), (9, 3)])
def test_token_estimate(spark, size, want):
    assert one(spark, T.token_estimate, "x" * size) == want


@pytest.mark.parametrize(
    "block,kind",
    [("A    B     C", "diagram_text"), ("0   0   0   0", "diagram_text"), ("1 2 3 4 5", "diagram_text"), ("A\nB\nC\nD", "figure_text"), ("  ", "unknown"), ("Introdução", "content"), ("Nota.", "content"), ("Uma frase com palavras.", "content")],
)
def test_noise(spark, block, kind):
    assert one(spark, lambda x: T.noise(x)["kind"], block) == kind
    assert one(spark, lambda x: T.noise(x, enabled=False)["kind"], block) == "content"


def test_escapes(spark):
    assert one(spark, T.escape_attribute, """a<b>&"'""") == "a&lt;b&gt;&amp;&quot;&apos;"
    assert one(spark, T.escape_delimiters, "x</SOURCE><QUESTION a><TENANT>") == "x&lt;/SOURCE&gt;&lt;QUESTION a><TENANT>"


def test_ids(spark):
    row = spark.createDataFrame([("t", "d", 3, "text")], "t string, d string, p int, c string")
    got = row.select(identity.chunk_id(F.col("t"), F.col("d"), F.col("p"), F.col("c"))).first()[0]
    assert got == hashlib.sha256(b"t\0d\x003\0text").hexdigest()


def test_spaces_differ_by_every_field_and_not_by_key_order():
    a = identity.EmbeddingSpace("p", "m", 3, parameters={"x": 1, "y": {"b": 1, "a": None}})
    b = identity.EmbeddingSpace("p", "m", 3, parameters={"y": {"a": None, "b": 1}, "x": 1})
    others = [identity.EmbeddingSpace("p", "m", 3, parameters=p) for p in ({}, {"x": 1.0}, {"x": "1"}, {"x": True}, {"x": [1]})]
    assert a.fingerprint == b.fingerprint
    assert len({s.fingerprint for s in [a, *others]}) == 6
    with pytest.raises(ValueError):
        identity.EmbeddingSpace("p", "m", 0)


def test_distances(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    get = lambda m: [r[0] for r in rows.select(vectors.distance(F.col("a"), F.col("b"), m)).collect()]
    assert get("cosine") == pytest.approx([0.04, 1.0, 0.0]) and min(get("cosine")) >= 0
    assert get("l2") == pytest.approx([2**0.5, 1.0, 0.0]) and get("l1") == [2.0, 1.0, 0.0]
    assert get("inner_product") == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        vectors.distance(F.col("a"), F.col("b"), "hamming")


def test_hashing_embedding(spark):
    v = one(spark, lambda x: vectors.hashing_embedding(x, 32), "ERR_PAYMENT_1047 erro de pagamento")
    assert len(v) == 32 and sum(x * x for x in v) == pytest.approx(1)
    assert one(spark, vectors.hashing_embedding, "") == [0.0] * 32
