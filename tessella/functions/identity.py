"""Content-addressed ids and fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import sha256_of


def chunk_id(tenant: Column, document: Column, position: Column, content: Column) -> Column:
    return sha256_of(tenant, document, position, content)


def file_document_id(tenant: Column, path: Column, identifier: Column, content: Column) -> Column:
    """identifier: whole-file or paragraph:{i}."""
    return sha256_of(tenant, path, identifier, F.sha2(content, 256))


def page_window_id(tenant: Column, path: Column, first_page: Column, last_page: Column) -> Column:
    return sha256_of(tenant, path, first_page, last_page)


def direct_version(tenant: Column, collection: Column, document: Column, space: Column) -> Column:
    return sha256_of(tenant, collection, document, space, F.lit("direct-store"))


def version_id(*, tenant: Column, collection: Column, document: Column, status: Column, content: Column, metadata: Column, space: Column, chunking: Column, version_status: Column, revision: Column, valid_from: Column, valid_until: Column, supersedes: Column) -> Column:
    """Hash of the thirteen fields. metadata: map<string,string>, put in key order first; null bounds count as empty."""
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))
    at = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    return sha256_of(tenant, collection, document, status, content, ordered, space, chunking, version_status, revision, at(valid_from), at(valid_until), F.coalesce(supersedes, F.lit("")))


def canonical(value) -> str:
    """A type-tagged string form in which no two different values are equal."""
    if value is None:
        return "n"
    if isinstance(value, bool):
        return f"b{int(value)}"
    if isinstance(value, int):
        return f"i<{value}>"
    if isinstance(value, float):
        return f"f<{json.dumps(value)}>"
    if isinstance(value, str):
        return f"s<{len(value.encode())}>:{value}"
    if isinstance(value, Mapping) and value:
        inside = "".join(f"K{len(str(k).encode())}:{k}{canonical(v)}" for k, v in sorted(value.items()))
        return f"m{len(value)}{{{inside}}}"
    if isinstance(value, (Sequence, Mapping)):
        return f"l{len(value)}{{{''.join(f'k{i}{canonical(v)}' for i, v in enumerate(value))}}}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


@dataclass(frozen=True)
class EmbeddingSpace:
    """Vectors are comparable inside one space only."""

    provider: str
    model: str
    dimensions: int
    revision: str = "1"
    parameters: Mapping = field(default_factory=dict)

    def __post_init__(self):
        if not (self.provider.strip() and self.model.strip() and self.revision.strip()) or self.dimensions < 1:
            raise ValueError("a space needs provider, model, revision and at least one dimension")

    @property
    def fingerprint(self) -> str:
        fields = (("provider", self.provider), ("model", self.model), ("dimensions", self.dimensions), ("revision", self.revision), ("parameters", self.parameters))
        form = f"m{len(fields)}{{{''.join(f'K{len(k)}:{k}{canonical(v)}' for k, v in fields)}}}"
        return hashlib.sha256(form.encode()).hexdigest()


def fingerprint(*parts) -> str:
    return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()
