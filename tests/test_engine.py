import json

import pytest
from pyspark.sql import functions as F

from tessella.errors import EngineError, IncompatibleSchemaError, IngestionError, InsufficientContextError, InvalidEmbeddingError, ProviderError, StreamingNotSupportedError
from tessella.functions.identity import EmbeddingSpace
from tessella.operators import embed, versions
from tessella.plans import rag
from tessella.plans.config import Config
from tessella.plans.engine import Engine
from tessella.schema import CHUNKS, check
from tessella.sources import golden
from tessella.sources.store import ChunkStore

DOC = "document_id string, tenant_id string, content string, metadata map<string,string>, collection string, status string"


def docs(spark, **texts):
    return spark.createDataFrame([(k, "t", v, {}, "c", "active") for k, v in texts.items()], DOC)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store", config=Config(tenant="t", collection="c", maximum_distance=None, limit=3))


def test_ingest_search_ask_stream(spark, engine):
    report = engine.ingest(docs(spark, refund="Refunds take 14 days after the return arrives.", error="ERR_PAYMENT_1047 means the card was declined.", stock="Reserved stock is released at midnight."))
    assert {r["state"] for r in report.collect()} == {"active"}
    found = engine.search("What does ERR_PAYMENT_1047 mean?")
    assert found.results.orderBy("rank").first()["document_id"] == "error"
    facts = found.diagnostics.first()
    assert facts["queries"][0] == "What does ERR_PAYMENT_1047 mean?" and "ERR_PAYMENT_1047" in facts["queries"] and facts["fused_ids"]
    told = engine.ask("What does ERR_PAYMENT_1047 mean?").answers.first()
    assert told["answer"] == "ERR_PAYMENT_1047 means the card was declined." and told["answered"] and told["prompt_characters"] > 100
    parts = list(engine.stream("What does ERR_PAYMENT_1047 mean?"))
    assert "".join(p.content for p in parts) == told["answer"] and parts[-1].final and [p.sequence for p in parts] == list(range(len(parts)))


def test_other_tenants_see_nothing(spark, engine):
    engine.ingest(docs(spark, a="some text about queues"))
    other = engine.questions("queues").withColumn("tenant_id", F.lit("u"))
    assert engine.search(other).results.count() == 0
    row = engine.ask(other).answers.first()
    assert row["answer"] == rag.NO_EVIDENCE_MESSAGE and not row["answered"] and row["prompt_characters"] == 0
    with pytest.raises(InsufficientContextError):
        list(rag.stream_answer(other, engine.search(other).results, engine.model))


def test_new_versions_supersede_and_repeats_change_nothing(spark, engine):
    engine.ingest(docs(spark, a="old text"))
    engine.ingest(docs(spark, a="old text"))
    assert engine.store.active().count() == 1
    engine.ingest(docs(spark, a="new text"))
    assert [r["content"] for r in engine.store.active().collect()] == ["new text"]
    assert sorted(r["ingestion_state"] for r in engine.store.rows().collect()) == ["active", "superseded"]


def test_a_failing_document_fails_alone(spark, engine):
    report = engine.ingest(docs(spark, good="text", blank="  \n "))
    assert {r["document_id"]: r["state"] for r in report.collect()} == {"good": "active", "blank": "failed"}
    assert engine.store.active().count() == 1
    strict = Engine(spark, engine.store.root + "2", config=Config(tenant="t", collection="c", fail_fast=True))
    with pytest.raises(IngestionError) as e:
        strict.ingest(docs(spark, good="text", blank=" "))
    assert strict.store.active().count() == 0 and e.value.report.count() == 2


def batch(spark, *rows, version="v", state="active"):
    space = EmbeddingSpace("p", "m", 2)
    full = [(c, d, version, state, t, col, "active", text, pos, {}, [1.0, 0.0], "p", "m", 2, "1", space.fingerprint, None, None, None, None, None) for c, d, t, col, text, pos in rows]
    return spark.createDataFrame(full, CHUNKS)


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    assert store.rows().count() == 0
    store.store(batch(spark, ("c1", "d", "a", "x", "one", 0), ("c2", "d", "a", "x", "two", 1)))
    store.store(batch(spark, ("c1", "d", "b", "x", "one", 0)))
    store.store(batch(spark, ("c1", "d", "a", "x", "changed", 9)))
    got = {(r["tenant_id"], r["chunk_id"]): (r["content"], r["position"], r["ingestion_state"]) for r in store.rows().collect()}
    assert got == {("a", "c1"): ("changed", 0, "active"), ("a", "c2"): ("two", 1, "active"), ("b", "c1"): ("one", 0, "active")}
    with pytest.raises(ValueError):
        store.store(batch(spark, ("c1", "d", "a", "x", "1", 0), ("c1", "d", "a", "x", "2", 0)))
    with pytest.raises(ValueError):
        store.store(batch(spark, ("c1", "d", "a", "x", "1", 0), ("c1", "d", "b", "x", "2", 0)))
    fp = EmbeddingSpace("p", "m", 2).fingerprint
    assert store.delete_chunk("a", "x", "c2", fp) == 1 and store.delete_chunk("a", "x", "c2", fp) == 0
    assert store.delete_document("a", "d") == 1 and store.rows().count() == 1
    assert store.clear_collection("b", "x") == 1 and store.rows().count() == 0
    store.store(batch(spark, ("c1", "d", "a", "x", "again", 0)))
    assert [r["content"] for r in store.active().collect()] == ["again"]


def test_staged_versions_are_invisible_until_activated(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    old, new = batch(spark, ("c", "d", "a", "x", "old", 0), version="1"), batch(spark, ("c", "d", "a", "x", "new", 0), version="2")
    for rows in (old, new):
        store.begin(rows)
    store.stage(old)
    store.activate(old)
    store.stage(new)
    assert [r["content"] for r in store.active().collect()] == ["old"]
    store.fail(new)
    assert {r["ingestion_state"] for r in store.rows().collect()} == {"active", "failed"}
    store.begin(new)
    with pytest.raises(EngineError):
        store.activate(new)
    store.stage(new)
    store.activate(new)
    assert {r["content"]: r["ingestion_state"] for r in store.rows().collect()} == {"old": "superseded", "new": "active"}


def test_version_rules(spark):
    rows = spark.createDataFrame([("d", 0, "v1", "2026-01-01", "2026-03-01"), ("d", 1, "v2", "2026-02-01", "2026-04-01"), ("d", 2, "v3", "2026-05-01", None), ("e", 3, "v4", "2026-01-15", None)], "document_id string, ord int, version_id string, f string, u string")
    rows = rows.withColumns({"valid_from": F.to_timestamp("f"), "valid_until": F.to_timestamp("u"), "version_status": F.lit("active")})
    assert [(r["left_version"], r["right_version"]) for r in versions.conflicts(rows).collect()] == [("v1", "v2")]
    at = F.to_timestamp(F.lit("2026-06-01"))
    assert sorted(r["version_id"] for r in rows.where(versions.is_valid_at(at, F.col("valid_from"), F.col("valid_until"))).collect()) == ["v3", "v4"]
    bad = rows.withColumn("valid_until", F.col("valid_from"))
    assert versions.invalid_versions(bad).count() == 4 and versions.invalid_versions(rows).count() == 0


def test_missing_columns_are_told_together(spark):
    with pytest.raises(IncompatibleSchemaError) as e:
        check(spark.createDataFrame([("a",)], "chunk_id string"))
    assert "embedding" in e.value.missing and "chunk_id" not in e.value.missing


def test_cache_embeds_equal_texts_once(spark):
    rows = spark.createDataFrame([("t", "aa"), ("t", "bbb"), ("t", "aa"), ("u", "aa")], "tenant_id string, content string")
    done, new = embed.embedded_once(rows, embed.HashingProvider())
    assert done.count() == 4 and new.count() == 3
    more = spark.createDataFrame([("t", "aa"), ("t", "cccc")], "tenant_id string, content string")
    again, newer = embed.embedded_once(more, embed.HashingProvider(), new)
    assert newer.count() == 1 and again.count() == 2


def test_providers_check_replies():
    space = EmbeddingSpace("p", "m", 2)
    reply = {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}
    made = lambda r: embed.IndexedHttpProvider(space, "https://x.test/v1", "k", post=lambda *a: r)
    assert made(reply).embed(["a", "b"]) == [[1, 0], [0, 1]]
    for bad in ({"data": reply["data"][:1]}, {"data": [{"index": 0, "embedding": [1, 0]}] * 2}, {"data": [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]}):
        with pytest.raises(InvalidEmbeddingError):
            made(bad).embed(["a", "b"])
    assert embed.PositionalHttpProvider(space, "http://x.test", post=lambda *a: {"embeddings": [[1, 2]]}).embed(["a"]) == [[1, 2]]
    for url in ("ftp://x", "https://u:p@x", "https://x?q=1", "https://x#f", "nohost"):
        with pytest.raises(ValueError):
            embed.check_url(url)


def test_chat_models():
    chat = rag.ChatHttpModel("m", "https://x.test/chat", rag.openai_text, post=lambda *a: {"choices": [{"message": {"content": "hi"}}]})
    assert chat.complete([{"role": "user", "content": "x"}]) == "hi"
    with pytest.raises(ProviderError):
        rag.ChatHttpModel("m", "https://x.test", rag.openai_text, post=lambda *a: {"choices": []}).complete([])
    parts = {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "no", "thought": True}, {"text": "yes"}]}}]}
    assert rag.candidate_text(parts) == "yes"
    with pytest.raises(ProviderError):
        rag.candidate_text({"candidates": [{"finishReason": "SAFETY"}]})
    line = lambda t: b"data: " + json.dumps({"choices": [{"delta": {"content": t}}]}).encode()
    assert list(rag.server_events([line("a"), b"", line("b"), b"data: [DONE]"])) == ["a", "b"]
    with pytest.raises(ProviderError):
        list(rag.server_events([line("a")]))
    with pytest.raises(StreamingNotSupportedError):
        list(rag.stream_answer(None, None, object()))


def test_failing_model_fails_one_question(spark):
    class Picky:
        fingerprint = "picky"

        def complete(self, messages):
            if "bad" in messages[1]["content"]:
                raise TimeoutError
            return "ok"

    asked = spark.createDataFrame([("1", "t", "good"), ("2", "t", "bad")], "question_id string, tenant_id string, content string")
    sources = spark.createDataFrame([("1", 1, "c", "d", 0, "x"), ("2", 1, "c", "d", 0, "x")], "question_id string, rank int, chunk_id string, document_id string, position int, content string")
    got = {r["question_id"]: (r["answer"], r["error"]) for r in rag.answer(asked, sources, Picky()).answers.collect()}
    assert got == {"1": ("ok", None), "2": (None, "TimeoutError")}


def test_config():
    c = Config.from_environment({"TESSELLA_LIMIT": "7", "TESSELLA_MAXIMUM_DISTANCE": "off", "TESSELLA_HYBRID": "false", "TESSELLA_METRIC": "l2"}, limit=9)
    assert (c.limit, c.maximum_distance, c.hybrid, c.metric) == (9, None, False, "l2")
    for bad in ({"limit": 0}, {"chunk_overlap": 1000}, {"vector_weight": float("nan")}, {"tenant": " "}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_golden_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"id": "a", "question": "q", "relevantChunkIds": ["c"]}, {"id": "b", "question": "q", "expectNoEvidence": True}]))
    assert golden.read_cases(spark, str(path)).count() == 2
    path.write_text(json.dumps([{"id": "a", "question": "q"}, {"id": "a", "question": " ", "expectNoEvidence": True, "expectedTerms": ["x"]}]))
    with pytest.raises(ValueError, match="more than once"):
        golden.read_cases(spark, str(path))


def test_streaming_ingest(spark, tmp_path, engine):
    from tessella.streaming.ingest import ingest_files

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("first text")
    for n in (1, 2):
        ingest_files(spark, str(source), engine.store, engine.provider, str(tmp_path / "progress"), tenant="t", config=engine.config).awaitTermination()
        assert engine.store.active().count() == n
        (source / "b.txt").write_text("second text")


def test_a_reranking_service_is_checked(spark):
    from tessella.errors import ProviderError, RerankerError
    from tessella.operators.fuse import HttpReranker, rerank_with, timed_out

    def service(results):
        return HttpReranker("service", "m", "http://x.example", "k", post=lambda url, payload, headers, timeout: {"results": results})

    good = service([{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}])
    assert good("q", ["a", "b"]) == [0.1, 0.9]
    for bad in (None, [], [{"index": 0, "relevance_score": 1}] * 2, [{"index": 0, "relevance_score": 1}, {"index": 2, "relevance_score": 1}], [{"index": 0, "relevance_score": 2.0}, {"index": 1, "relevance_score": 0}], [{"index": True, "relevance_score": 0}, {"index": 0, "relevance_score": 0}]):
        with pytest.raises(RerankerError):
            service(bad)("q", ["a", "b"])

    def late(url, payload, headers, timeout):
        raise ProviderError("late") from TimeoutError("30 s")

    with pytest.raises(RerankerError) as e:
        HttpReranker("service", "m", "http://x.example", post=late)("q", ["a"])
    assert e.value.timed_out and timed_out(e.value) and not timed_out(ValueError("x"))
    rows = spark.createDataFrame([("q", "text", "a", 1, "one"), ("q", "text", "b", 2, "two")], "question_id string, question string, chunk_id string, rank int, content string")
    got = rerank_with(rows, lambda q, c: [0.1, 7.0]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"] and got[0]["rerank_failed"] and "RerankerError" in got[0]["rerank_error"] and not got[0]["rerank_timed_out"]


def test_windows_of_batches_run_together_and_fail_as_one():
    import threading

    from tessella.errors import BatchWindowError
    from tessella.functions.identity import EmbeddingSpace
    from tessella.operators.embed import in_windows

    class Slow:
        space = EmbeddingSpace("p", "m", 1)

        def __init__(self):
            self.meet = threading.Barrier(3, timeout=20)

        def embed(self, texts):
            self.meet.wait()  # three requests must be under way at once
            if "bad" in texts:
                raise ValueError("no")
            return [[float(len(t))] for t in texts]

    assert in_windows(Slow(), ["a", "bb", "ccc", "d", "ee", "f"], 2, 3) == [[1.0], [2.0], [3.0], [1.0], [2.0], [1.0]]
    with pytest.raises(BatchWindowError) as e:
        in_windows(Slow(), ["a", "b", "c", "d", "bad", "e"], 1, 3)
    assert (e.value.failed, e.value.started, e.value.completed, e.value.discarded) == (4, [3, 4, 5], [0, 1, 2], [3, 5])


def test_services_are_asked_once(spark, tmp_path):
    from tessella.functions.identity import EmbeddingSpace

    calls = tmp_path / "calls"
    calls.mkdir()

    class Service:
        space = EmbeddingSpace("p", "m", 2)

        def embed(self, texts):
            for t in texts:
                (calls / f"{abs(hash(t))}-{len(list(calls.iterdir()))}").write_text(t)
            return [[1.0, float(len(t) % 3)] for t in texts]

    class Told:
        fingerprint = "told"

        def complete(self, messages):
            (calls / f"chat-{len(list(calls.iterdir()))}").write_text("x")
            return "an answer"

    docs = spark.createDataFrame([("1", "t", "the red fox pays a refund", {"a": "b"}, "c", "active"), ("2", "t", "the red fox pays a refund", {"a": "b"}, "c", "active")], "document_id string, tenant_id string, content string, metadata map<string,string>, collection string, status string")
    config = Config(tenant="t", collection="c", maximum_distance=None, abstain=False, concurrency=1, heuristic_rewriter=False)
    engine = Engine(spark, str(tmp_path / "store"), config=config, provider=Service(), model=Told(), caches=True)
    engine.ingest(docs)
    assert len(list(calls.iterdir())) == 1
    for _ in range(2):
        told = engine.ask("Who pays a refund?").answers.collect()
        assert told[0]["answer"] == "an answer"
    assert len(list(calls.iterdir())) == 3  # the text, the question, the answer
    seen = engine.search("Who pays a refund?").diagnostics.first().asDict()
    assert seen["original_question"] == "Who pays a refund?"
    assert seen["reranker_provider"] == "textual" and seen["selected_ids"] and set(seen["milliseconds"]) == {"embedding", "search", "fusion", "selection"}


def test_settings_build_services():
    from tessella.operators.embed import HashingProvider, IndexedHttpProvider
    from tessella.plans.rag import contents_of

    assert isinstance(Config().provider(), HashingProvider)
    set_ = Config.from_environment({"TESSELLA_EMBEDDING_KIND": "indexed", "TESSELLA_EMBEDDING_URL": "http://e.example", "TESSELLA_EMBEDDING_MODEL": "m", "TESSELLA_MAXIMUM_DISTANCE": "0.3"}, maximum_distance=None)
    assert isinstance(set_.provider(), IndexedHttpProvider) and set_.maximum_distance is None
    for bad in ({"embedding_kind": "indexed"}, {"text_search": "klingon"}, {"fused_limit": 0}, {"neighbors_after": -1}):
        with pytest.raises(ValueError):
            Config(**bad)
    asked = contents_of("m", [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}])
    assert asked == {"systemInstruction": {"parts": [{"text": "s"}]}, "contents": [{"role": "user", "parts": [{"text": "u"}]}, {"role": "model", "parts": [{"text": "a"}]}]}


def test_decomposed_letters_compare_equal(spark):
    import unicodedata

    from tessella.functions.text import comparable

    texts = ["Coração é ÜBER ñandú", "ελληνικά", "plain", ""]
    rows = spark.createDataFrame([(t, unicodedata.normalize("NFD", t)) for t in texts], "a string, b string")
    assert all(r[0] == r[1] for r in rows.select(comparable(rows["a"]), comparable(rows["b"])).collect())
