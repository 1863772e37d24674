"""Functions for SQL: register(spark), then SELECT chunk_text(text), hash_embed(text), ..."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import split_text
from ..sources.html import extract_blocks, is_blocked_host
from .embedders import chinese_embedder, hash_embedder


def register(spark: SparkSession) -> list[str]:
    hashed, ngrams = hash_embedder(), chinese_embedder()

    @F.pandas_udf("array<struct<text:string,start:int,end:int>>")
    def chunk_text(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"text": p, "start": a, "end": b} for p, a, b in split_text(t or "")])

    @F.pandas_udf("array<double>")
    def hash_embed(s: pd.Series) -> pd.Series:
        return s.map(hashed.embed)

    @F.pandas_udf("array<double>")
    def ngram_embed(s: pd.Series) -> pd.Series:
        return s.map(ngrams.embed)

    @F.pandas_udf("string")
    def html_text(s: pd.Series) -> pd.Series:
        return s.map(lambda h: "\n\n".join(t for t, _ in extract_blocks(h or "")[0]))

    @F.pandas_udf("boolean")
    def blocked_host(s: pd.Series) -> pd.Series:
        return s.map(is_blocked_host)

    found = {"chunk_text": chunk_text, "hash_embed": hash_embed, "ngram_embed": ngram_embed, "html_text": html_text, "blocked_host": blocked_host}
    for name, f in found.items():
        spark.udf.register(name, f)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
      RETURN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
        sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)""")
    return [*found, "cosine"]
