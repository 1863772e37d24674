"""Evidence contexts, citations and grounded answers, in batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_truncate, strip

#: Fixed value: the answer where nothing was found.
NO_EVIDENCE = "知识库中没有找到足够相关的内容，暂时无法根据知识库确认这个问题。"
MAX_CHARS = 8000


def header(number: Column, path: Column, page: Column, headings: Column, chunk_id: Column) -> Column:
    """First line of an item of evidence."""
    at_page = F.when(page.isNotNull(), F.concat(F.lit("，第 "), page.cast("string"), F.lit(" 页"))).otherwise("")
    under = F.when(F.size(F.coalesce(headings, F.array().cast("array<string>"))) > 0, F.concat(F.lit("，章节："), F.array_join(headings, " / "))).otherwise("")
    return F.concat(F.lit("["), number.cast("string"), F.lit("] 来源："), path, at_page, under, F.lit("（chunk_id="), chunk_id, F.lit("）\n"))


def evidence_context(results: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """query_id, context: numbered items up to a budget of characters.

    ``results``: query_id, rank, chunk_id, source_path, page_start, heading_path,
    text. Only an item's text is cut, never its header. What is collected per
    query is its top k.
    """
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    item = F.struct("rank", header(F.col("rank"), F.col("source_path"), F.col("page_start"), F.col("heading_path"), F.col("chunk_id")).alias("head"), strip(F.col("text")).alias("body"))
    items = results.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(max_chars) - acc["used"]
        fits = F.length(x["head"]) + F.length(x["body"]) <= room
        cut = safe_truncate(x["body"], room - F.length(x["head"]))
        stop = acc["done"] | (room <= 0) | (~fits & (room - F.length(x["head"]) <= 0))
        piece = F.concat(x["head"], F.when(fits, x["body"]).otherwise(cut))
        return F.when(stop, F.struct(acc["text"].alias("text"), acc["used"].alias("used"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.concat(acc["text"], F.when(acc["text"] == "", "").otherwise("\n\n"), piece).alias("text"), (acc["used"] + F.length(piece) + 2).alias("used"), acc["done"].alias("done"))
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    return items.select("query_id", F.aggregate("items", start, step)["text"].alias("context"))


def location(path: Column, page: Column, headings: Column) -> Column:
    """Where a citation points to: path, page, headings."""
    at = F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string")))
    under = F.when(F.size(F.coalesce(headings, F.array().cast("array<string>"))) > 0, F.array_join(headings, " / "))
    return F.concat_ws(", ", path, at, under)


def citation_numbers(answer: Column, n: Column) -> Column:
    """Distinct cited numbers from 1 to n, ascending."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(cited, lambda x: (x >= 1) & (x <= n))))


def citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """The results that an answer cites; all of them if it cites none."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"))
    cited = answers.join(n, "query_id").select("query_id", citation_numbers(F.col("answer"), F.col("n")).alias("numbers"))
    met = results.join(cited, "query_id")
    return met.filter((F.size("numbers") == 0) | F.array_contains("numbers", F.col("rank").cast("bigint"))).drop("numbers")


def answer(queries: DataFrame, results: DataFrame, chat: Callable[[str, str], str] | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """query_id, question, answer, context: no evidence gives the fixed text
    without a call; without a model, the context itself is the answer."""
    met = queries.join(evidence_context(results, max_chars), "query_id", "left")
    if chat is None:
        return met.select("query_id", "question", F.coalesce("context", F.lit(NO_EVIDENCE)).alias("answer"), "context")

    @F.pandas_udf("string")
    def ask(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([chat(q, c) for q, c in zip(question, context, strict=True)], index=question.index)

    some = met.filter(F.col("context").isNotNull()).withColumn("answer", strip(ask("question", "context")))
    none = met.filter(F.col("context").isNull()).withColumn("answer", F.lit(NO_EVIDENCE))
    return some.unionByName(none).select("query_id", "question", "answer", "context")
