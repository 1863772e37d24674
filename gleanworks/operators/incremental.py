"""Merging a scanned directory into the stored snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(path: Column, root: str, is_dir: bool = True) -> Column:
    """The scanned file itself, or what lies under the scanned directory."""
    root = root.rstrip("/") or "/"
    own = path == root
    return own | path.startswith(root if root == "/" else root + "/") if is_dir else own


def classify(files: DataFrame, manifests: DataFrame, chunk_counts: DataFrame, root: str, chunking_fingerprint: str, is_dir: bool = True) -> DataFrame:
    """One row per source: added, updated, unchanged, failed, deleted or kept.

    ``files``: source_path, content_hash, ingestion_fingerprint, error (null if
    readable). ``manifests``: source_path, content_hash, ingestion_fingerprint,
    chunking_fingerprint, chunk_count. ``chunk_counts``: source_path, chunks.
    A document is reused only if its hash, both fingerprints and the number of
    its stored chunks agree; nothing is parsed to find that out.
    """
    named = manifests.filter(F.trim("source_path") != "")
    old = named.select("source_path", *(F.col(c).alias(f"old_{c}") for c in ("content_hash", "ingestion_fingerprint", "chunking_fingerprint", "chunk_count")), F.lit(True).alias("known"))
    met = files.withColumn("present", F.lit(True)).join(old, "source_path", "full_outer").join(chunk_counts, "source_path", "full_outer")
    same = (
        F.col("content_hash").eqNullSafe(F.col("old_content_hash"))
        & F.col("ingestion_fingerprint").eqNullSafe(F.col("old_ingestion_fingerprint"))
        & F.col("old_chunking_fingerprint").eqNullSafe(F.lit(chunking_fingerprint))
        & (F.coalesce("old_chunk_count", F.lit(-1)) == F.coalesce("chunks", F.lit(0)))
    )
    status = (
        F.when(F.col("present").isNull(), F.when(F.lit(is_dir) & in_scope(F.col("source_path"), root, is_dir), "deleted").otherwise("kept"))
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("known").isNotNull() & same, "unchanged")
        .when(F.col("known").isNotNull(), "updated")
        .otherwise("added")
    )
    return met.select("source_path", status.alias("status"), F.coalesce("chunks", F.lit(0)).alias("old_chunks"))


def counters(classes: DataFrame, new_chunks: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    made = new_chunks.join(classes.filter(F.col("status").isin("added", "updated")), "source_path", "left_semi").agg(F.count("*").alias("chunks_generated"))
    seen = classes.agg(
        *(count(s).alias(f"documents_{s}") for s in ("added", "updated", "unchanged", "deleted", "failed")),
        F.coalesce(F.sum(F.when(F.col("status") == "unchanged", F.col("old_chunks"))), F.lit(0)).alias("chunks_reused"),
    )
    return seen.join(F.broadcast(made))  # one row each


def merge(old: DataFrame, new: DataFrame, classes: DataFrame) -> DataFrame:
    """The next snapshot of chunks or manifests: new rows of added and updated
    sources, old rows of all others but deleted ones. A failed source keeps its
    last good version."""
    fresh = classes.filter(F.col("status").isin("added", "updated")).select("source_path")
    gone = classes.filter(F.col("status").isin("added", "updated", "deleted")).select("source_path")
    return old.join(gone, "source_path", "left_anti").unionByName(new.join(fresh, "source_path", "left_semi"), allowMissingColumns=True)


def ordered(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy(F.lower("source_path"), "chunk_index", "chunk_id")
