"""Splitting blocks into overlapping chunks with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.text import by_slices

#: Characters behind which a piece may end.
BOUNDARIES = "\n。！？；.!?; "
#: Matches up to the last of them: the engine steps back from the end of what it may look at.
_BOUNDARY = re.compile(f".*[{re.escape(BOUNDARIES)}]", re.S)


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 1200
    overlap_chars: int = 120

    def __post_init__(self) -> None:
        if self.max_chars <= 0 or not 0 <= self.overlap_chars < self.max_chars:
            raise ValueError("need max_chars > 0 and 0 <= overlap_chars < max_chars")

    @property
    def fingerprint(self) -> str:
        return identity.chunking_fingerprint(self.max_chars, self.overlap_chars)


def _cuts(body: str, config: ChunkConfig) -> Iterator[tuple[int, int]]:
    """Where pieces start and end; only the second half of a piece is searched for a boundary."""
    start, least = 0, max(1, config.max_chars // 2)
    while start + config.max_chars < len(body):
        last = start + config.max_chars
        found = _BOUNDARY.match(body, start + least, last)
        stop = found.end() if found else last
        yield start, stop
        start = max(start + 1, stop - config.overlap_chars)
    if body:
        yield start, len(body)


def split_text(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, int, int]]:
    """(piece, start, end): each at most ``max_chars``, cut behind the last
    boundary of its second half, overlapping the one before."""
    body = text.strip()
    skipped = text.find(body)
    spans = ((start, body[start:stop]) for start, stop in _cuts(body, config))
    trimmed = ((skipped + start + len(x) - len(x.lstrip()), x.strip()) for start, x in spans)
    return [(x, at, at + len(x)) for at, x in trimmed if x]


_PIECE = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def pieces(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<text, start, end>> of a text column."""

    def cut(texts: list[str | None]) -> pa.Array:
        found = [split_text(t or "", config) for t in texts]
        flat = [pa.array([x[n] for f in found for x in f], _PIECE[n].type) for n in range(3)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_PIECE)))

    @F.arrow_udf("array<struct<text:string,start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return by_slices(cut, pa.list_(_PIECE), texts)

    return run(text)


def chunk_blocks(blocks: DataFrame, config: ChunkConfig = ChunkConfig(), one_block: bool = False) -> DataFrame:
    """Chunks of blocks.

    ``blocks``: doc_id, source_id, source_path, file_type, content_hash,
    ingestion_fingerprint, block_pos, text, extraction_method, page_number,
    heading_path, normalized_char_start, warnings. Chunk numbers run on through
    a document's blocks; the only shuffle is by document, and there is none where
    each has ``one_block``, whose pieces are numbered already.
    """
    cut = blocks.select("*", F.posexplode(pieces(F.coalesce("text", F.lit("")), config)).alias("piece_pos", "piece"))
    along = Window.partitionBy("doc_id").orderBy("block_pos", "piece_pos")
    numbered = cut.withColumn("chunk_index", F.col("piece_pos") if one_block else F.row_number().over(along) - 1)
    chunk_hash = identity.sha256(F.col("piece.text"))
    fp = F.lit(config.fingerprint)
    start, end = (F.col("normalized_char_start") + F.col(f"piece.{k}") for k in ("start", "end"))
    ident = identity.chunk_id(F.col("source_id"), F.col("doc_id"), F.col("content_hash"), F.col("chunk_index"), chunk_hash, F.col("ingestion_fingerprint"), fp)
    return numbered.select(
        ident.alias("chunk_id"), "doc_id", "source_id", "source_path", "file_type", F.col("piece.text").alias("text"), "chunk_index",
        chunk_hash.alias("content_hash"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "heading_path",
        start.alias("normalized_char_start"), end.alias("normalized_char_end"), F.array("extraction_method").alias("extraction_methods"), "warnings",
        F.lit(identity.INGESTION_VERSION).alias("ingestion_version"), F.lit(identity.CHUNKING_VERSION).alias("chunking_version"),
        "ingestion_fingerprint", fp.alias("chunking_fingerprint"),
    )


def manifest(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: counts, and sorted distinct attributes of its blocks."""
    each = blocks.groupBy("doc_id").agg(
        F.count("*").alias("block_count"),
        F.sort_array(F.collect_set("page_number")).alias("pages"),
        F.sort_array(F.collect_set("extraction_method")).alias("extraction_methods"),
        F.sort_array(F.collect_set("encoding")).alias("encodings"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("block_warnings"),
    )
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.first("chunking_fingerprint").alias("chunking_fingerprint"))
    none = F.array().cast("array<string>")
    joined = documents.join(each, "doc_id", "left").join(counted, "doc_id", "left")
    return joined.withColumns(
        {
            "block_count": F.coalesce("block_count", F.lit(0)),
            "chunk_count": F.coalesce("chunk_count", F.lit(0)),
            "warnings": F.array_sort(F.array_union(F.coalesce("warnings", none), F.coalesce("block_warnings", none))),
        }
    ).drop("block_warnings")
