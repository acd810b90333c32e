import json

from tessella.plans.config import Config
from tessella.plans.engine import Engine
from tessella.plans.evaluation import evaluate_engine
from tessella.sources import golden


def test_cases_through_the_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", config=Config(tenant="t", collection="c", maximum_distance=None, limit=2))
    docs = [("refund", "t", "Refunds take 14 days.", {}, "c", "active"), ("error", "t", "ERR_PAYMENT_1047 means the card was declined.", {}, "c", "active")]
    engine.ingest(spark.createDataFrame(docs, "document_id string, tenant_id string, content string, metadata map<string,string>, collection string, status string"))
    cases = [
        {"id": "good", "question": "What does ERR_PAYMENT_1047 mean?", "relevantDocumentIds": ["error"], "expectedTerms": ["declined"], "relevantEvidence": [{"documentId": "error", "requiredTextGroups": [["card", "cards"]]}]},
        {"id": "wrong", "question": "Refunds take how long?", "relevantDocumentIds": ["nothing"]},
        {"id": "none", "question": "queues", "tenantId": "other", "expectNoEvidence": True},
    ]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(cases))
    got = evaluate_engine(engine, golden.read_cases(spark, str(path)), language="en")
    values = {(r["case_id"], r["metric"]): r["value"] for r in got.scores.collect()}
    assert values["good", "document_recall"] == values["good", "document_hit_at_1"] == values["good", "expected_terms"] == values["good", "evidence_recall"] == values["good", "groundedness"] == 1
    assert values["wrong", "document_recall"] == 0 and values["none", "no_evidence"] == 1
    status = {r["case_id"]: r["status"] for r in got.statuses.collect()}
    assert status["wrong"] == "failed" and status["none"] == "passed"
    assert {r["metric"]: r["cases"] for r in got.report.collect()}["document_recall"] == 2
