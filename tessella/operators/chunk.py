"""Chunks of documents: sliding windows that end at natural boundaries, and packed structural blocks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.identity import chunk_id, fingerprint
from tessella.functions.text import TRIM, normalized

SIZE, OVERLAP = 1000, 150
#: What ends a window, the first kind that occurs late enough: an empty line, a line, a sentence, white space.
_ENDS = [re.compile(p) for p in (r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows over normalised text; without their overlaps they join to the text."""
    least, start, found = max(overlap + 1, size // 2), 0, []
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            window = text[start:end]
            for pattern in _ENDS:
                late = [m.end() for m in pattern.finditer(window) if m.end() >= least]
                if late:
                    end = start + late[-1]
                    break
        if text[start:end].strip(TRIM):
            found.append(text[start:end])
        if end == len(text):
            break
        start = end - overlap
    return found


def recursive_chunks(documents: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row a chunk: the document's columns with its content, position, chunk_id."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size, and neither negative")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([windows(t, size, overlap) for t in texts])

    rest = [c for c in documents.columns if c != "content"]
    rows = documents.select(*rest, F.posexplode(split(normalized(F.col("content")))).alias("position", "content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("tenant_id"), F.col("document_id"), F.col("position"), F.col("content")))


def recursive_fingerprint(size: int = SIZE, overlap: int = OVERLAP) -> str:
    return fingerprint("recursive-text-splitter", "2", size, overlap)


@dataclass(frozen=True)
class Limit:
    """How much a structural chunk holds: characters, blocks, or estimated tokens."""

    kind: str
    most: int
    characters_a_token: float = 4

    def __post_init__(self):
        if self.kind not in ("characters", "blocks", "tokens") or self.most < 1:
            raise ValueError("a limit is a positive number of characters, blocks or tokens")

    @property
    def fingerprint(self) -> str:
        return f"{self.kind}:{self.most}" + (f":{self.characters_a_token}" if self.kind == "tokens" else "")

    def fits(self, content: str, blocks: int) -> bool:
        if self.kind == "blocks":
            return blocks <= self.most
        if self.kind == "tokens":
            return max(1, -(-len(content) // self.characters_a_token)) <= self.most
        return len(content) <= self.most

    def pieces(self, content: str) -> list[str]:
        """What a block that doesn't fit is cut into: at the last line end or space of each window, if late enough."""
        if self.kind == "blocks":
            return [content]
        most = self.most if self.kind == "characters" else max(1, int(self.most * self.characters_a_token))
        found, at = [], 0
        while len(content) - at > most:
            window = content[at : at + most]
            end = max(window.rfind("\n"), window.rfind(" "))
            end = at + (end if end > most // 2 else most)
            found.append(content[at:end].strip(TRIM))
            at = end + len(content[end:]) - len(content[end:].lstrip(TRIM))
        return [p for p in [*found, content[at:].strip(TRIM)] if p]


def packed(blocks: list, limit: Limit) -> list[dict]:
    """Blocks to chunks. A heading or section starts a chunk; others join while they fit; a block too large is cut."""
    path: list[str] = []
    chunks: list[dict] = []
    held: list = []
    text = ""

    def close() -> None:
        nonlocal held, text
        if text.strip(TRIM):
            meta: dict = {}
            for b, _ in held:
                meta.update(b["meta"])
            first = held[0]
            pages = [b["meta"] for b, _ in held if "page_start" in b["meta"]]
            if pages:
                ends = [int(pages[0]["page_start"]), int(pages[-1]["page_end"])]
                meta |= {"page_start": str(min(ends)), "page_end": str(max(ends))}
            chunks.append({"content": text, "block_type": first[0]["type"], "path": first[1], "meta": meta})
        held, text = [], ""

    for b in blocks:
        b = {**b, "meta": dict(b["meta"])}  # maps come as lists of pairs or dicts
        if b["excluded"]:
            continue
        if b["type"] in ("heading", "section"):
            # a column with missing levels arrives as floats
            level = int(b["level"]) if b["level"] is not None and b["level"] == b["level"] else len(path) + 1
            path = path[: max(0, level - 1)] + [b["content"]]
            close()
        if not b["content"]:
            continue
        joined = f"{text}\n\n{b['content']}" if text else b["content"]
        if text and not limit.fits(joined, len(held) + 1):
            close()
            joined = b["content"]
        if not limit.fits(b["content"], 1):
            for piece in limit.pieces(b["content"]):
                held, text = [(b, list(path))], piece
                close()
            continue
        held.append((b, list(path)))
        text = joined
    close()
    return chunks


def structural_chunks(documents: DataFrame, limit: Limit, parse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row a chunk, with block_type, hierarchy and merged metadata; documents need `blocks`, or are parsed first."""
    from tessella.operators.parse import parsed

    documents = documents if "blocks" in documents.columns else (parse or parsed)(documents)
    chunk = "struct<content:string,block_type:string,path:array<string>,meta:map<string,string>>"

    @F.pandas_udf(f"array<{chunk}>")
    def pack(column: pd.Series) -> pd.Series:
        return pd.Series([packed(list(blocks), limit) for blocks in column])

    rest = [c for c in documents.columns if c not in ("content", "blocks", "metadata")]
    rows = documents.select(*rest, "metadata", F.posexplode(pack("blocks")).alias("position", "c"))
    own = F.create_map(F.lit("block_type"), F.col("c.block_type"), F.lit("hierarchy_path"), F.array_join("c.path", " > "))
    every = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(F.col("c.meta"), k) & ~k.isin("block_type", "hierarchy_path")), F.map_filter(F.col("c.meta"), lambda k, v: ~k.isin("block_type", "hierarchy_path")), own)
    rows = rows.select(*rest, "position", F.col("c.content").alias("content"), F.col("c.block_type").alias("block_type"), F.col("c.path").alias("hierarchy"), every.alias("metadata"))
    return rows.withColumn("chunk_id", chunk_id(F.col("tenant_id"), F.col("document_id"), F.col("position"), F.col("content")))


def structural_fingerprint(limit: Limit) -> str:
    return fingerprint("structural-text-splitter", "2", limit.fingerprint, "parsers-1")
