import pytest

from tessella.operators import fulltext


def test_queries():
    none = "simple"
    assert fulltext.parse_query('fast "red fox" -slow or cat -"big dog"', none) == [([["fast"], ["red", "fox"]], [["slow"]]), ([["cat"]], [["big", "dog"]])]
    assert fulltext.parse_query("-only", none) == [] and fulltext.parse_query("", none) == []
    assert fulltext.parse_query("o que", "portuguese") == []
    with pytest.raises(ValueError):
        fulltext.stop_words("klingon")


@pytest.mark.parametrize(
    "places,rank", [([[0, 5]], 0.2), ([[0], [1]], 0.1), ([[0], [3]], 0.1 / 3), ([[0, 4], [1]], 0.1 + 0.1 / 3), ([[0], []], 0.0), ([[2], [5], [3]], 0.1 / 2)]
)
def test_cover_density(places, rank):
    assert fulltext.cover_density(places) == pytest.approx(rank)


def test_search(spark):
    chunks = spark.createDataFrame([("error", "t", "the code ERR_PAYMENT_1047 means a declined card"), ("other", "t", "a declined red card, a red card"), ("phrase", "t", "card red"), ("far", "u", "ERR_PAYMENT_1047")], "chunk_id string, tenant_id string, content string")
    asked = spark.createDataFrame([("id", "t", "ERR_PAYMENT_1047"), ("ph", "t", '"red card"'), ("no", "t", "declined -code"), ("or", "t", "code or phrase or red"), ("none", "t", "unknown")], "question_id string, tenant_id string, content string")
    got = {}
    for r in fulltext.fulltext_search(chunks, asked, analyser="english").orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append(r["chunk_id"])
    assert got == {"id": ["error"], "ph": ["other"], "no": ["other"], "or": ["other", "error", "phrase"]}


def test_stems():
    from tessella.functions.stem import english, portuguese

    # samples that the algorithms' publication gives
    en = "consigned consign consistency consist consolatory consolatori conspiracy conspiraci knackeries knackeri kneaded knead generously generous hoping hope running run ties tie skies sky proceed proceed".split()
    pt = "boataria boat bobagem bobag bobalhões bobalhõ bocadinho bocadinh quilométricas quilométr quilômetro quilômetr quintuplicou quintuplic quiosque quiosqu quisessem quis quinhão quinhã".split()
    assert [english(w) for w in en[::2]] == en[1::2] and [portuguese(w) for w in pt[::2]] == pt[1::2]


def test_search_finds_other_forms_of_a_word(spark):
    chunks = spark.createDataFrame([("pt", "os pagamentos recusados"), ("en", "payments were refused"), ("no", "outra coisa")], "chunk_id string, content string")
    asked = spark.createDataFrame([("a", "pagamento recusado"), ("b", "refusing payment")], "question_id string, content string")
    for analyser, want in (("portuguese", {"a": "pt"}), ("english", {"a": "pt", "b": "en"}), ("simple", {})):
        assert {r["question_id"]: r["chunk_id"] for r in fulltext.fulltext_search(chunks, asked, analyser=analyser).collect()} == want


def test_search_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    words = "red fox ran over the lazy dogs and a-b c.d cats running".split()
    texts = {f"c{n}": " ".join(rng.choices(words, k=rng.randint(0, 12))) for n in range(80)}
    queries = {f"q{n}": " ".join(rng.choice([w, f'"{w} {rng.choice(words)}"', f"-{w}", "or", w]) for w in rng.choices(words, k=rng.randint(1, 4))) for n in range(40)}
    chunks, asked = spark.createDataFrame(list(texts.items()), "chunk_id string, content string"), spark.createDataFrame(list(queries.items()), "question_id string, content string")
    for analyser in ("simple", "english"):
        want = {}
        for q, query in queries.items():
            scores = {c: fulltext.score(fulltext.parse_query(query, analyser), fulltext.lexemes(t, analyser)) for c, t in texts.items()}
            for c in sorted((c for c, s in scores.items() if s > 0), key=lambda c: (-round(scores[c], 9), c))[:20]:
                want[q, c] = round(scores[c], 6)
        got = {(r["question_id"], r["chunk_id"]): round(r["lexical_score"], 6) for r in fulltext.fulltext_search(chunks, asked, analyser=analyser).collect()}
        assert got == want and len(want) > 50
