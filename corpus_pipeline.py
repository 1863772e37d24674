"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of ``documents``; the last returns
the packed pieces.

Defined cases, for every stage: columns besides doc_id, text, lang and n_chars are
carried through as they are, whatever their names (also those that an operator
adds); null doc_ids are kept, and rows that share one are told apart by their text;
documents with null or empty text have no letter, so the first stage drops them; of
rows that are repeated, line dedup takes each for the same copy and the third stage
keeps one; among near copies the smallest doc_id stays; empty tables give empty
results; texts are worked on whole, of any length that Spark holds (2 GB).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import decontaminate, langid, line_dedup, near_dedup, packing
from gleanworks.llm.common import materialise, table

#: SQL can't express sketches, language prototypes or packing.
ORACLE_SQL = None


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but doc_id and text under names of our own, so that none
    meets an operator's, and the expressions that give the columns back."""
    names = [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that can have no language: those with no letter. Without labelled
    documents to learn from, all others stay too."""
    own, columns = _hidden(docs)
    found = langid.predict(own, *langid.learn(docs.select("doc_id", "text", "lang")))
    return found.filter("has_letter").select(columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs and of passages in one line; documents that had nothing else go."""
    found = line_dedup.dedup_lines(docs, passage=line_dedup.PASSAGE)
    left = found.filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("record.n_chars"))}
    return left.select(*(fresh.get(c, F.col(f"record.`{c}`")).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (and one of repeated rows)."""
    own, columns = _hidden(docs)
    found = materialise(near_dedup.near_duplicates(docs.select("doc_id", "text")))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & F.xxhash64("text").eqNullSafe(F.col("other_hash"))
    keys = [F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")]
    left = own.join(found.filter(~F.col("kept")).select(keys).distinct(), same, "left_anti")
    twice = found.filter("kept").groupBy(keys).count().filter("count > 1").select("other_id", "other_hash")
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.select(columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    own, columns = _hidden(docs)
    found = decontaminate.find_contamination(own, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("spans") == 0).select(columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
