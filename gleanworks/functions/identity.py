"""Content-derived identities, as columns and as driver-side constants."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that make ids comparable from run to run.
INGESTION_VERSION = CHUNKING_VERSION = "0.2"
SPLIT_STRATEGY = "character-natural-boundary-v1"
HTML_EXTRACTOR = "bs4-main-v1"
PDF_EXTRACTOR = "pymupdf-page-blocks-v1"


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def config_fingerprint(namespace: str, values: Mapping[str, object]) -> str:
    """Of a configuration: made once on the driver, attached as a literal."""
    body = json.dumps(dict(values), ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    return sha256_text(f"{namespace}:v1:{body}")


def chunking_fingerprint(max_chars: int = 1200, overlap_chars: int = 120) -> str:
    return config_fingerprint("chunking", {"version": CHUNKING_VERSION, "strategy": SPLIT_STRATEGY, "max_chars": max_chars, "overlap_chars": overlap_chars})


def ingestion_fingerprint(file_type: str, encoding: str = "utf-8-sig") -> str:
    if file_type == "html":
        return config_fingerprint("ingestion", {"file_type": "html", "extractor": HTML_EXTRACTOR, "collapse_whitespace": True})
    values = {"file_type": file_type, "normalization": "crlf_to_lf", "encoding": encoding}
    if file_type == "markdown":
        values["heading_parser"] = "atx-v1"
    return config_fingerprint("ingestion", values)


def ingestion_fingerprint_of(file_type: Column, encoding: Column, encodings: list[str]) -> Column:
    """The fingerprint as a column over a closed set of encodings."""
    out = F.lit(ingestion_fingerprint("html"))
    for kind in ("txt", "markdown"):
        for name in encodings:
            out = F.when((file_type == kind) & (encoding == name), ingestion_fingerprint(kind, name)).otherwise(out)
    return out


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def source_id(path: Column) -> Column:
    """Of a canonical path or normalised URL."""
    return sha256(F.concat(F.lit("source:v1:"), path))


def document_id(source: Column, content_hash: Column) -> Column:
    return sha256(F.concat(F.lit("document:v1:"), source, F.lit("|"), content_hash))


def upgraded_document_id(doc_id: Column, source: Column, content_hash: Column) -> Column:
    """Old snapshots used the content hash as doc_id."""
    return F.when(doc_id == content_hash, document_id(source, content_hash)).otherwise(doc_id)


def chunk_id(source: Column, doc: Column, doc_hash: Column, index: Column, chunk_hash: Column, ingestion_fp: Column, chunking_fp: Column) -> Column:
    return sha256(F.concat_ws("|", F.lit("chunk:v2"), source, doc, doc_hash, index.cast("string"), chunk_hash, ingestion_fp, chunking_fp))


def aliased_offsets(normalized: Column, alias: Column) -> Column:
    """The normalised offset wins over its older alias."""
    return F.coalesce(normalized, alias)
