import pytest
from pyspark.sql import functions as F

from tessella.operators import fuse, search, select


def ids(df, *order):
    return [r["chunk_id"] for r in df.orderBy(*order).collect()]


def rankings(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows], "question_id string, ranking string, query_no int, query string, rank int, chunk_id string, distance double, lexical_score double")


def test_rrf_breaks_ties_by_distance(spark):
    df = rankings(spark, ("vector", 0, "q1", 1, "a", 0.3, None), ("vector", 0, "q1", 2, "b", 0.2, None), ("vector", 1, "q2", 1, "b", 0.2, None), ("vector", 1, "q2", 2, "a", 0.3, None))
    rows = fuse.fuse(df, limit=5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a"] and rows[0]["fusion_score"] == rows[1]["fusion_score"]
    assert [m["query"] for m in rows[0]["matches"]] == ["q1", "q2"]


def test_rrf_weights(spark):
    df = rankings(spark, ("vector", 0, "q", 1, "V", 0.1, None), ("vector", 0, "q", 2, "L", 0.2, None), (fuse.LEXICAL, 1, "l", 1, "L", 0.5, 2.0), (fuse.LEXICAL, 1, "l", 2, "V", 0.6, 1.0))
    assert ids(fuse.fuse(df, limit=2, weights={"vector": 0.5, fuse.LEXICAL: 1.0}), "rank") == ["L", "V"]
    assert ids(fuse.fuse(df, limit=2, weights={"vector": 1.0, fuse.LEXICAL: 0.0}), "rank") == ["V", "L"]
    with pytest.raises(ValueError):
        fuse.fuse(df, limit=2, weights={"vector": -1.0})


def ranked(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows], "question_id string, question string, rank int, chunk_id string, content string, distance double")


def test_textual_reranker(spark):
    df = ranked(spark, ("Como funciona Dijkstra?", 1, "other", "Heap", 0.1), ("Como funciona Dijkstra?", 2, "dijkstra", "O Dijkstra usa heap", 0.4))
    rows = fuse.rerank(df).orderBy("rank").collect()
    assert [(r["chunk_id"], r["reranker_score"], r["rank_before"]) for r in rows] == [("dijkstra", 0.5, 2), ("other", 0.0, 1)]
    assert ids(fuse.rerank(df, candidate_limit=1), "rank") == ["other"]


def test_a_failing_reranker_keeps_the_order(spark):
    df = ranked(spark, ("x", 1, "a", "one", 0.1), ("x", 2, "b", "two", 0.2))

    def broken(question, contents):
        raise TimeoutError

    for model in (broken, lambda q, c: [0.5], lambda q, c: [2.0, 0.1]):
        rows = fuse.rerank_with(df, model).orderBy("rank").collect()
        assert [r["chunk_id"] for r in rows] == ["a", "b"] and rows[0]["rerank_failed"]
    good = fuse.rerank_with(df, lambda q, c: [float(len(c) - i) / 9 for i in range(len(c), 0, -1)])
    assert ids(good, "rank") == ["b", "a"] and fuse.is_permutation(df, good) and not fuse.is_permutation(df, good.limit(1))


def rewritten(spark, text):
    rows = fuse.rewrite_queries(spark.createDataFrame([("q", text)], "question_id string, content string")).orderBy("query_no").collect()
    return [r["query"] for r in rows]


def test_rewriter(spark):
    got = rewritten(spark, "Converta para PHP a função Python optimal_bst com e[i,j].")
    assert got[0].startswith("Converta") and "optimal_bst" in got and "e[i,j]" not in got[:1] and len(got) <= 4
    assert rewritten(spark, "sem termos aqui") == ["sem termos aqui"]
    assert rewritten(spark, "Como usar Dijkstra") == ["Como usar Dijkstra", "Dijkstra"] or "Dijkstra" in rewritten(spark, "Como usar Dijkstra")


CASES = [
    ("Explique Fibonacci recursivo em PHP", [("primary", "a", 0.10, False, "Fibonacci recursivo em PHP"), ("noise", "b", 0.12, False, "texto sobre outra coisa")], {}, ["primary_evidence", "duplicate_evidence"]),
    ("Explique Fibonacci recursivo em PHP", [("primary", "a", 0.10, False, "Fibonacci recursivo"), ("support", "a", 0.14, False, "código PHP")], {}, ["primary_evidence", "same_document_support"]),
    ("Compare Dijkstra e Bellman-Ford", [("d", "a", 0.10, False, "Dijkstra"), ("b", "b", 0.40, False, "Bellman-Ford"), ("h", "c", 0.41, False, "heap")], {}, ["primary_evidence", "additional_coverage", "distance_gap"]),
    ("Explique PHP e Fibonacci", [("primary", "a", 0.10, False, "PHP aqui"), ("external", "b", 0.11, False, "Fibonacci externo"), ("same", "a", 0.15, False, "Fibonacci mesmo")], {}, ["primary_evidence", "duplicate_evidence", "same_document_support"]),
    ("Explique assinatura e retorno", [("primary", "a", 0.10, False, "assinatura"), ("near", "a", 0.10, True, "retorno")], {}, ["primary_evidence", "neighbor_context"]),
    ("Explique Fibonacci PHP", [("primary", "a", 0.1, False, "Fibonacci PHP igual"), ("copy", "b", 0.1, False, "Fibonacci PHP igual")], {}, ["primary_evidence", "duplicate_evidence"]),
    ("Explique PHP", [("primary", "a", 0.1, False, "PHP"), ("minimum", "b", 0.2, False, "outra"), ("limited", "c", 0.3, False, "mais")], {"minimum_sources": 2, "maximum_sources": 2}, ["primary_evidence", "additional_coverage", "source_limit"]),
]


@pytest.mark.parametrize("question,candidates,policy,reasons", CASES)
def test_adaptive_selection(spark, question, candidates, policy, reasons):
    rows = [("q", question, n, i, d, x, nb, text) for n, (i, d, x, nb, text) in enumerate(candidates, 1)]
    df = spark.createDataFrame(rows, "question_id string, question string, rank int, chunk_id string, document_id string, distance double, neighbor boolean, content string")
    got = select.adaptive_select(df, select.RelevancePolicy(**policy)).orderBy("rank").collect()
    assert [r["reason"] for r in got] == reasons
    assert [r["selected"] for r in got] == [r in select.SELECTED for r in reasons]


def hits(spark, *rows):
    return spark.createDataFrame([("q", *r) for r in rows], "question_id string, question string, chunk_id string, content string, lexical_score double")


def test_abstention(spark):
    why = lambda df: select.abstain(df).first()["abstain_reason"]
    assert why(hits(spark, ("algoritmo Wesley", "weak", "nada a ver", None))) == "isolated_vector_hit_without_named_term"
    assert why(hits(spark, ("a Árvore AVL", "a", "uma árvore avl", None))) is None
    assert why(hits(spark, ("algoritmo Wesley", "a", "nada", 0.5))) is None
    assert why(hits(spark, ("algoritmo Wesley", "a", "nada", None), ("algoritmo Wesley", "b", "nada", None))) is None
    asked = spark.createDataFrame([("q",), ("none",)], "question_id string")
    told = {r["question_id"]: r["reason"] for r in select.abstentions(asked, select.abstain(hits(spark, ("x Wesley", "w", "y", None)))).collect()}
    assert told == {"q": "isolated_vector_hit_without_named_term", "none": "no_candidates"}


CHUNK = "chunk_id string, document_id string, document_version string, position int, content string"


def test_neighbours_and_budget(spark):
    chunks = spark.createDataFrame([("heading", "d", "v", 0, "12345"), ("main", "d", "v", 1, "1234567"), ("code", "d", "v", 2, "12345"), ("far", "d", "v", 3, "x"), ("other", "e", "v", 0, "x")], CHUNK)
    hit = chunks.where("chunk_id = 'main'").selectExpr("'q' question_id", "1 rank", "*", "0.1 distance")
    wide = select.expand_neighbors(hit, chunks)
    assert [(r["chunk_id"], r["neighbor"]) for r in wide.orderBy("rank").collect()] == [("heading", True), ("main", False), ("code", True)]
    assert all(r["distance"] for r in wide.collect())
    kept = select.budget(wide, limit=3, maximum_characters=12).orderBy("rank").collect()
    assert [r["budget_reason"] for r in kept] == [None, None, "context_budget"]
    both = chunks.where("chunk_id in ('main', 'code')").selectExpr("'q' question_id", "position rank", "*", "0.1 distance")
    assert ids(select.expand_neighbors(both, chunks), "rank") == ["heading", "main", "code", "far"]
    assert ids(select.expand_neighbors(hit.withColumn("document_version", F.lit(None).cast("string")), chunks), "rank") == ["main"]


def test_a_shorter_chunk_may_still_fit(spark):
    rows = [("q", n, "x" * size) for n, size in enumerate([5, 9, 4, 1], 1)]
    got = select.budget(spark.createDataFrame(rows, "question_id string, rank int, content string"), limit=2, maximum_characters=10).orderBy("rank").collect()
    assert [r["budget_reason"] for r in got] == [None, "context_budget", None, "source_limit"]


def test_vector_search_scope(spark):
    chunks = spark.createDataFrame([("a", "d", "t1", [1.0, 0.0]), ("b", "d", "t2", [1.0, 0.0]), ("c", "d", "t1", [0.0, 1.0]), ("z", "d", "t1", [1.0, 0.0])], "chunk_id string, document_id string, tenant_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", "t1", [1.0, 0.0])], "question_id string, tenant_id string, query_embedding array<double>")
    assert ids(search.vector_search(chunks, asked, keys=["question_id"], limit=3), "rank") == ["a", "z", "c"]
    assert ids(search.vector_search(chunks, asked, keys=["question_id"], limit=3, maximum_distance=0.5), "rank") == ["a", "z"]
    for bad in ({"limit": 0}, {"limit": 101}, {"maximum_distance": -1}):
        with pytest.raises(ValueError):
            search.vector_search(chunks, asked, keys=["question_id"], **bad)


def test_lexical_search_counts_whole_questions_and_weights(spark):
    chunks = spark.createDataFrame([("1", "d", "ERR_PAYMENT_1047 means declined"), ("2", "d", "payment declined"), ("3", "d", "xpay"), ("4", "d", "the big red fox jumps")], "chunk_id string, document_id string, content string")
    asked = spark.createDataFrame([("e", "ERR_PAYMENT_1047"), ("p", "pay"), ("f", "big red fox"), ("r", "declined declined zzz")], "question_id string, content string")
    got = {(r["question_id"], r["chunk_id"]): round(r["lexical_score"], 4) for r in search.lexical_search(chunks, asked).collect()}
    assert got == {("e", "1"): 2.4, ("p", "1"): 1.0, ("p", "2"): 1.0, ("p", "3"): 1.0, ("f", "4"): 1.3333, ("r", "1"): 0.6667, ("r", "2"): 0.6667}


def test_lexical_search_against_all_pairs(spark):
    import random
    import re

    from tessella.functions.text import LEXICAL_STOP_WORDS

    rng = random.Random(1)
    words = "a bb ccc de x-y que da bcc".split()
    texts = {str(i): " ".join(rng.choices(words, k=rng.randint(1, 7))) for i in range(60)}
    asked = {str(i): " ".join(rng.choices(words, k=rng.randint(1, 4))) for i in range(40)} | {"s": "c"}
    tokens = lambda t: [w for w in re.findall(r"[\w-]+", t.lower()) if w not in LEXICAL_STOP_WORDS]
    want = {}
    for q, terms in asked.items():
        for c, text in texts.items():
            if (qt := tokens(terms)) and (n := sum((1.4 if "-" in w else 1) for w in qt if w in tokens(text)) + (terms in text)):
                want[q, c] = round(n / len(qt), 6)
    chunks = spark.createDataFrame([(c, "d", t) for c, t in texts.items()], "chunk_id string, document_id string, content string")
    questions = spark.createDataFrame(list(asked.items()), "question_id string, content string")
    for few in (2000, 1):  # sent to the chunks, or joined
        got = {(r["question_id"], r["chunk_id"]): round(r["lexical_score"], 6) for r in search.lexical_search(chunks, questions, limit=100, few=few).collect()}
        assert got == want
