"""Retrieval evaluation: hit rate and precision of what was returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_distinct, strip


def samples(rows: DataFrame) -> DataFrame:
    """Cleaned samples (ordinal, name, query, label arrays, min_score); ``problem``
    says what is wrong with a row, or is null."""
    none = F.array().cast("array<string>")
    clean = rows.select(
        "ordinal",
        F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.concat(F.lit("sample-"), F.col("ordinal"))).alias("name"),
        strip(F.col("query")).alias("query"),
        ordered_distinct(F.coalesce("relevant_chunk_ids", none)).alias("relevant_chunk_ids"),
        ordered_distinct(F.coalesce("relevant_source_paths", none)).alias("relevant_source_paths"),
        F.col("min_score").cast("double").alias("min_score"),
    )
    return clean.withColumn(
        "problem",
        F.when(F.coalesce(F.col("query"), F.lit("")) == "", "query is empty")
        .when(F.size("relevant_chunk_ids") + F.size("relevant_source_paths") == 0, "no label")
        .when(F.isnan("min_score") | (F.abs("min_score") == float("inf")), "min_score is not finite"),
    )


def sample_results(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """Per sample: what was returned and relevant. ``found``: query_id (the
    sample's ordinal), chunk_id, source_path."""
    relevant = F.array_contains("relevant_chunk_ids", F.col("chunk_id")) | F.array_contains("relevant_source_paths", F.col("source_path"))
    joined = labelled.join(found.withColumnRenamed("query_id", "ordinal"), "ordinal", "left")
    each = joined.groupBy("ordinal", "name").agg(F.count("chunk_id").alias("returned"), F.count_if(F.coalesce(relevant, F.lit(False))).alias("relevant"))
    return each.select(
        "ordinal", "name", "returned", "relevant",
        F.when(F.col("relevant") > 0, 1.0).otherwise(0.0).alias("recall_at_k"),
        F.when(F.col("returned") > 0, F.col("relevant") / F.col("returned")).otherwise(0.0).alias("citation_accuracy"),
    )


def report(results: DataFrame) -> DataFrame:
    """Means over samples: recall_at_k is the share with any hit."""
    return results.agg(F.count("*").alias("sample_count"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("citation_accuracy").alias("citation_accuracy"))
