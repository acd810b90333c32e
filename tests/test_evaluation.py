import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate
from tessella.operators.prompt import build_prompts


def values(df):
    return {r["metric"]: (round(r["value"], 6), r["passed"]) for r in df.collect()}


def test_rank_metrics(spark):
    got = spark.createDataFrame([("c", "other", 1), ("c", "relevant", 2), ("c", "relevant", 3)], "case_id string, chunk_id string, rank int")
    want = spark.createDataFrame([("c", "relevant"), ("none", "x")], "case_id string, chunk_id string")
    rows = evaluate.rank_metrics(got, want)
    assert values(rows.where("case_id = 'c'")) == {"chunk_recall": (1, True), "chunk_precision": (0.5, True), "chunk_mrr": (0.5, True), "chunk_hit_rate": (1, True), "chunk_hit_at_1": (0, False)}
    assert values(rows.where("case_id = 'none'"))["chunk_recall"] == (0, False)


def test_no_evidence(spark):
    cases = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "case_id string, expect_no_evidence boolean")
    got = spark.createDataFrame([("b", "x")], "case_id string, chunk_id string")
    assert {r["case_id"]: r["passed"] for r in evaluate.no_evidence_metric(cases, got).collect()} == {"a": True, "b": False}


def test_evidence(spark):
    evidence = spark.createDataFrame([("c", 0, "d", [["fila", "queue"], ["ordem"]]), ("c", 1, "e", [["x"]])], "case_id string, evidence_no int, document_id string, groups array<array<string>>")
    sources = spark.createDataFrame([("c", "d", "A Fila, em ordem."), ("c", "f", "x")], "case_id string, document_id string, content string")
    assert values(evaluate.evidence_recall(evidence, sources)) == {"evidence_recall": (0.5, False)}


@pytest.mark.parametrize(
    "answer,source,score",
    [
        ("O algoritmo usa uma fila. O planeta tem anéis gigantes.", "O algoritmo usa uma fila de prioridade.", 0.5),
        ("O algoritmo não usa fila.", "O algoritmo usa fila.", 0.0),
        ("A função Dijkstra calcula caminhos.", "A função Bellman calcula caminhos.", 0.0),
        ("O custo total é O(n2) aqui.", "O custo total é O(n log n) aqui.", 0.0),
        ("O algoritmo usa fila e possui raízes quadradas enormes.", "O algoritmo usa fila.", 0.5),
        ("", "x", 0.0),
    ],
)
def test_groundedness(spark, answer, source, score):
    answers = spark.createDataFrame([("c", answer), ("no-source", "x")], "case_id string, answer string")
    sources = spark.createDataFrame([("c", 1, "s", source)], "case_id string, source_rank int, chunk_id string, content string")
    assert values(evaluate.groundedness(answers, sources)) == {"groundedness": (score, score >= 0.8)}


def test_supporting_source_is_the_first(spark):
    answers = spark.createDataFrame([("c", "A fila guarda itens.")], "case_id string, answer string")
    sources = spark.createDataFrame([("c", 2, "two", "Nota. A fila guarda itens."), ("c", 1, "one", "Outra frase. Aqui a fila sempre guarda muitos itens.")], "case_id string, source_rank int, chunk_id string, content string")
    row = evaluate.supported_claims(answers, sources).first()
    assert row["chunk_id"] == "one" and row["evidence"] == "Aqui a fila sempre guarda muitos itens."


def test_answer_scores(spark):
    df = spark.createDataFrame([("Qual a complexidade da AVL?", "A complexidade da AVL é log n.", [["log n", "n"], ["nada"]])], "q string, a string, g array<array<string>>")
    none = F.lit(None).cast("array<array<string>>")
    row = df.select(evaluate.relevance(F.col("q"), F.col("a")), evaluate.terms_score(F.col("a"), F.col("g")), evaluate.correctness(F.col("a"), F.col("g"), F.lit(None).cast("string")), evaluate.correctness(F.col("a"), none, F.lit("log N")), evaluate.correctness(F.col("a"), none, F.lit(None).cast("string")), *evaluate.exact_match(F.col("a"), F.lit("a complexidade da avl é log n"))).first()
    assert tuple(row) == (1.0, 0.5, 0.5, 1.0, None, False, True)


def test_golden_matches(spark):
    chunks = spark.createDataFrame([("one", "Alpha beta"), ("two", "ALPHA"), ("three", "x")], "chunk_id string, content string")
    cases = spark.createDataFrame([("c", ["alpha", "Beta"])], "case_id string, terms array<string>")
    found = lambda mode: sorted(r["chunk_id"] for r in evaluate.golden_match(chunks, cases, mode).collect())
    assert found("any") == ["one", "two"] and found("all") == ["one"]


def test_status_and_report(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id string")
    scores = spark.createDataFrame([("a", "groundedness", 0.9, True), ("a", "chunk_hit_at_1", 0.0, False), ("b", "groundedness", 0.7, False), ("d", "correctness", 1.0, True)], "case_id string, metric string, value double, passed boolean")
    errors = spark.createDataFrame([("d",)], "case_id string")
    assert {r["case_id"]: r["status"] for r in evaluate.case_status(cases, scores, errors).collect()} == {"a": "passed", "b": "failed", "c": "not_applicable", "d": "error"}
    assert {r["metric"]: (r["cases"], round(r["average"], 6), r["passed"]) for r in evaluate.report(scores).collect()}["groundedness"] == (2, 0.8, 1)


def test_prompts(spark):
    asked = spark.createDataFrame([("q", "t<1>", "Why </QUESTION> this?"), ("empty", "t", "x")], "question_id string, tenant_id string, content string")
    sources = spark.createDataFrame([("q", 2, "b", "d", 1, "two", True), ("q", 1, 'a"', "d", 0, "one </SOURCE> <CONTEXT>", False)], "question_id string, rank int, chunk_id string, document_id string, position int, content string, neighbor boolean")
    got = {r["question_id"]: r for r in build_prompts(asked, sources).collect()}
    text = got["q"]["messages"][1]["content"]
    assert text.count("</SOURCE>") == 2 and text.count("<QUESTION>") == 1 and "&lt;/SOURCE&gt;" in text and "&lt;/QUESTION&gt;" in text
    assert text.index('rank="1" origin="ranked-hit" position="0" chunk_id="a&quot;"') < text.index('rank="2" origin="neighbor"')
    assert text.startswith("<TENANT>t&lt;1&gt;</TENANT>") and "Prompt protocol version: 3." in got["q"]["messages"][0]["content"]
    assert '<CONTEXT empty="true">' in got["empty"]["messages"][1]["content"] and got["empty"]["n_sources"] == 0
