"""Settings: explicit values, else environment, else defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from tessella.functions.identity import EmbeddingSpace
from tessella.operators.embed import HashingProvider, IndexedHttpProvider, PositionalHttpProvider
from tessella.operators.fulltext import ANALYSERS
from tessella.operators.fuse import CONSTANT, check_weights
from tessella.operators.search import check_policy
from tessella.operators.select import RelevancePolicy

PREFIX = "TESSELLA_"
#: The offline embedding, and services that number their vectors or give them in the order of the texts.
PROVIDERS = ("hashing", "indexed", "positional")


@dataclass(frozen=True)
class Config:
    tenant: str = "default"
    collection: str = "default"
    limit: int = 5
    metric: str = "cosine"
    maximum_distance: float | None = 0.45
    candidate_limit: int = 20
    rewrite_queries: int = 4
    heuristic_rewriter: bool = True
    status: str = "active"
    hybrid: bool = True
    #: How words are looked for: `overlap` of tokens, or full text with the analyser `simple`, `english` or `portuguese`.
    text_search: str = "portuguese"
    lexical_candidate_limit: int | None = None
    fused_limit: int | None = None
    vector_weight: float = 0.5
    lexical_weight: float = 1.0
    fusion_constant: int = CONSTANT
    rerank: bool = True
    reranker_candidate_limit: int | None = None
    adaptive: bool = False
    abstain: bool = True
    neighbors_before: int = 0
    neighbors_after: int = 0
    maximum_characters: int | None = None
    chunk_size: int = 1000
    chunk_overlap: int = 150
    batch_size: int = 32
    concurrency: int = 4
    fail_fast: bool = False
    relevance_maximum_gap: float = 0.08
    relevance_minimum_sources: int = 1
    relevance_maximum_sources: int = 5
    relevance_prefer_same_document: bool = True
    no_evidence_message: str = "There is not enough evidence to answer this question."
    store_root: str | None = None
    embedding_kind: str = "hashing"
    embedding_url: str | None = None
    embedding_model: str | None = None
    embedding_key: str | None = None
    embedding_dimensions: int = 32
    chat_url: str | None = None
    chat_model: str | None = None
    chat_key: str | None = None

    def __post_init__(self):
        check_policy(self.limit, self.maximum_distance)
        check_policy(self.candidate_limit, None)
        check_weights({"vector": self.vector_weight, "lexical": self.lexical_weight})
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size, and neither negative")
        if self.batch_size < 1 or self.concurrency < 1 or self.fusion_constant < 1:
            raise ValueError("batch_size, concurrency and fusion_constant must be positive")
        for limit in (self.lexical_candidate_limit, self.fused_limit):
            if limit is not None:
                check_policy(limit, None)
        if self.text_search not in ("overlap", *ANALYSERS):
            raise ValueError(f"text_search must be overlap or one of {', '.join(ANALYSERS)}")
        if self.embedding_kind not in PROVIDERS:
            raise ValueError(f"embedding_kind must be one of {', '.join(PROVIDERS)}")
        if self.embedding_kind != "hashing" and not (self.embedding_url and self.embedding_model):
            raise ValueError("an embedding service needs embedding_url and embedding_model")
        if self.neighbors_before < 0 or self.neighbors_after < 0 or self.maximum_characters is not None and self.maximum_characters < 1:
            raise ValueError("numbers of neighbours can't be negative, maximum_characters must be positive")
        if not self.status.strip() or not self.no_evidence_message.strip():
            raise ValueError("status and no_evidence_message can't be blank")
        if not (self.tenant.strip() and self.collection.strip()):
            raise ValueError("tenant and collection can't be blank")

    @classmethod
    def from_environment(cls, environment=None, **explicit) -> Config:
        """Variables PREFIX + a field's name in capitals; null, none and off mean None."""
        environment = os.environ if environment is None else environment
        found = {}
        for f in fields(cls):
            text = environment.get(PREFIX + f.name.upper())
            if text is None:
                continue
            if text.strip().lower() in ("", "null", "none", "off"):
                found[f.name] = False if "bool" in str(f.type) else None
            elif "bool" in str(f.type):
                found[f.name] = text.strip().lower() in ("1", "true", "yes", "on")
            else:
                found[f.name] = float(text) if "float" in str(f.type) else int(text) if "int" in str(f.type) else text
        # what is given explicitly wins, None included
        return replace(cls(), **{**found, **explicit})

    def provider(self):
        """The embedding provider that the settings name."""
        if self.embedding_kind == "hashing":
            return HashingProvider(self.embedding_dimensions)
        space = EmbeddingSpace(self.embedding_kind, self.embedding_model, self.embedding_dimensions)
        if self.embedding_kind == "indexed":
            return IndexedHttpProvider(space, self.embedding_url, self.embedding_key)
        return PositionalHttpProvider(space, self.embedding_url)

    def relevance(self) -> RelevancePolicy:
        return RelevancePolicy(self.relevance_maximum_gap, self.relevance_minimum_sources, self.relevance_maximum_sources, self.relevance_prefer_same_document)
