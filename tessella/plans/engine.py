"""One object for ingesting, searching, asking and evaluating."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import ingest as ingestion
from tessella.plans import rag
from tessella.plans.config import Config
from tessella.plans.retriever import Outcome, retrieve
from tessella.sources.cache import ANSWERS, VECTORS, CacheTable
from tessella.sources.store import ChunkStore


#: Up to so many tenants of a table of questions are named in the scan's partition filter.
MOST_TENANTS = 1000


class Engine:
    """All methods work for Config's tenant unless questions bring their own."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, config: Config | None = None, provider=None, model=None, reranker=None, relevance=None, caches: bool = False):
        """caches: keep embeddings and answers of services beside the store, and ask a service only for what is not there."""
        self.spark, self.config = spark, config or Config.from_environment()
        root = root or self.config.store_root
        if not root:
            raise ValueError("a folder for the store must be given, or store_root set")
        self.store = ChunkStore(spark, root)
        self.provider, self.model = provider or self.config.provider(), model or self._model()
        self.reranker, self.relevance = reranker, relevance
        paid = caches and not hasattr(self.provider, "column")
        self.vectors = CacheTable(spark, f"{self.store.root}/cache/vectors", VECTORS) if paid else None
        self.answers = CacheTable(spark, f"{self.store.root}/cache/answers", ANSWERS) if caches else None

    def _model(self):
        c = self.config
        if not c.chat_url:
            return rag.ExtractiveModel()
        return rag.ChatHttpModel(c.chat_model, c.chat_url, rag.openai_text, {"Authorization": f"Bearer {c.chat_key}"} if c.chat_key else None)

    def ingest(self, documents: DataFrame, **how) -> DataFrame:
        return ingestion.ingest(documents, self.store, self.provider, self.config, cache=self.vectors, **how)

    def questions(self, *texts: str) -> DataFrame:
        rows = [(uuid.uuid4().hex if len(texts) > 1 else "q", self.config.tenant, self.config.collection, t) for t in texts]
        if any(not t.strip() for t in texts):
            raise ValueError("a question can't be blank")
        return self.spark.createDataFrame(rows, "question_id string, tenant_id string, collection string, content string")

    def search(self, questions: DataFrame | str, **how) -> Outcome:
        asked = self.questions(questions) if isinstance(questions, str) else questions
        # few tenants: only their partitions are read
        tenants = [r[0] for r in asked.select("tenant_id").distinct().limit(MOST_TENANTS + 1).collect()]
        return retrieve(asked, self.store.active(tenants if len(tenants) <= MOST_TENANTS else None), self.provider, self.config, reranker=self.reranker, relevance=self.relevance, cache=self.vectors, **how)

    def ask(self, questions: DataFrame | str, **how) -> rag.Answers:
        asked = self.questions(questions) if isinstance(questions, str) else questions
        return rag.answer(asked, self.search(asked, **how).results, self.model, message=self.config.no_evidence_message, cache=self.answers, concurrency=self.config.concurrency)

    def stream(self, question: str, **how) -> Iterator[rag.Delta]:
        asked = self.questions(question)
        return rag.stream_answer(asked, self.search(asked, **how).results, self.model)
