"""Documents from text files and from pages of laid-out documents."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.errors import PdfExtractionError
from tessella.functions.identity import file_document_id, page_window_id
from tessella.functions.text import trimmed

GRANULARITIES = ("whole_file", "paragraph")
PAGE_MARK, ESCAPED_MARK = "[[PAGE:", "[[SOURCE_PAGE:"
DOCUMENT = ("document_id", "tenant_id", "content", "metadata", "collection", "status")


def _metadata(source: Column, kind: str, granularity: str, extra: dict[str, str] | None) -> Column:
    own = {"source": source, "type": F.lit(kind), "granularity": F.lit(granularity)}
    # the caller's values win
    merged = {**own, **{k: F.lit(v) for k, v in (extra or {}).items()}}
    return F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), v)])


def text_files(files: DataFrame, tenant: str, *, granularity: str = "whole_file", collection: str = "default", status: str = "active", metadata: dict[str, str] | None = None) -> DataFrame:
    """Documents from rows (path, value): a file each, or a paragraph each, numbered without the blank ones."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}")
    if granularity == "whole_file":
        rows = files.select("path", trimmed(F.col("value")).alias("content"), F.lit("whole-file").alias("identifier"))
    else:
        parts = F.filter(F.transform(F.split("value", r"(?U)\R\s*\R"), trimmed), lambda p: p != "")
        rows = files.select("path", F.posexplode(parts).alias("n", "content")).select("path", "content", F.concat(F.lit("paragraph:"), "n").alias("identifier"))
    rows = rows.where(F.length("content") > 0)
    return rows.select(
        file_document_id(F.lit(tenant), F.col("path"), F.col("identifier"), F.col("content")).alias("document_id"),
        F.lit(tenant).alias("tenant_id"),
        "content",
        _metadata(F.col("path"), "text", granularity, metadata).alias("metadata"),
        F.lit(collection).alias("collection"),
        F.lit(status).alias("status"),
    )


def read_text_files(spark: SparkSession, path: str, tenant: str, **how) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text_files(files, tenant, **how)


def pages(texts: DataFrame) -> DataFrame:
    """(path, page, text) from rows (path, value) of text whose pages end in form feeds; a blank last page is none."""
    split = F.split("value", "\f")
    last = F.element_at(split, -1)
    kept = F.when((F.size(split) > 1) & (trimmed(last) == ""), F.slice(split, 1, F.size(split) - 1)).otherwise(split)
    return texts.select("path", F.posexplode(kept).alias("n", "text")).select("path", (F.col("n") + 1).alias("page"), "text")


def page_windows(pages: DataFrame, tenant: str, *, pages_a_window: int = 3, collection: str = "default", status: str = "active") -> DataFrame:
    """Documents of up to pages_a_window pages that are not blank, each behind its mark; marks in the text are defused."""
    if pages_a_window < 1:
        raise ValueError("a window has at least one page")
    text = F.replace(trimmed(F.col("text")), F.lit(PAGE_MARK), F.lit(ESCAPED_MARK))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("page"))
    marked = pages.where(trimmed(F.col("text")) != "").select("path", "page", F.concat(F.lit(PAGE_MARK), "page", F.lit("]]\n"), text).alias("part"), F.floor((nth - 1) / pages_a_window).alias("window"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda p: p["part"]), "\n\n")
    grouped = marked.groupBy("path", "window").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), joined.alias("content"))
    meta = F.create_map(F.lit("source"), F.col("path"), F.lit("type"), F.lit("pdf"), F.lit("page_start"), F.col("first_page").cast("string"), F.lit("page_end"), F.col("last_page").cast("string"))
    return grouped.select(
        page_window_id(F.lit(tenant), F.col("path"), F.col("first_page"), F.col("last_page")).alias("document_id"),
        F.lit(tenant).alias("tenant_id"),
        "content",
        meta.alias("metadata"),
        F.lit(collection).alias("collection"),
        F.lit(status).alias("status"),
    )


def page_text(name: str, raw: bytes, *, max_bytes: int, max_pages: int | None, timeout: int, program: str = "pdftotext") -> str:
    """The text of a PDF file by an external program; a typed error tells what went wrong."""
    if raw[:5] != b"%PDF-" or len(raw) > max_bytes:
        raise PdfExtractionError(f"{name} is no PDF of at most {max_bytes} bytes")
    last = ["-l", str(max_pages)] if max_pages is not None else []
    try:
        got = subprocess.run([program, "-layout", "-enc", "UTF-8", *last, "-", "-"], input=raw, capture_output=True, timeout=timeout, check=True)
    except FileNotFoundError as e:
        raise PdfExtractionError(f"{program} is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise PdfExtractionError(f"{name} took longer than {timeout} seconds") from e
    except subprocess.CalledProcessError as e:
        raise PdfExtractionError(f"{name} can't be read: exit code {e.returncode}") from e
    return got.stdout.decode("utf-8", "replace")


def extract_pages(spark: SparkSession, path: str, *, max_bytes: int = 50_000_000, max_pages: int | None = None, timeout: int = 60, program: str = "pdftotext") -> DataFrame:
    """(path, value) of PDF files, by the external program pdftotext on the executors; fails on files that are no PDF."""
    if max_pages is not None and max_pages < 1 or timeout < 1 or max_bytes < 1:
        raise ValueError("max_pages, timeout and max_bytes must be positive")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [page_text(name, bytes(raw), max_bytes=max_bytes, max_pages=max_pages, timeout=timeout, program=program) for name, raw in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "value": texts})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, "path string, value string")
