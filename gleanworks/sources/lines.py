"""JSON lines with their places: what breaks the contract is a row with file, line and reason.

Lines are numbered over the splits of a file: a split's rows count on from those of the splits
before it, so no file is read by one task. Blank lines count and are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROBLEMS = "file string, line long, problem string, value string"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are read: file, split (where it begins), row (rising within a split), value."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")


def numbered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of ``split_lines`` with ``line``, from 1 in each file. Only counts of splits are added up."""
    splits = lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", "first", before.alias("before"))
    return rows.join(starts, ["file", "split"]).withColumn("line", F.col("before") + F.col("row") - F.col("first") + 1).drop("first", "before", "split", "row")


def kind(v: Column, path: str) -> Column:
    """The type of a field of a variant: null if there is none, VOID if it is JSON's null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def object_problem(v: Column) -> Column:
    return F.when(v.isNull(), "not JSON").when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "not an object")


def scan_jsonl(spark: SparkSession, path: str, check=None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines: file, split, row, value, v (a variant), and PROBLEMS. ``check``: a function of
    the variant that gives a column with the reason a line is bad, or null."""
    lines = split_lines(spark, path)
    parsed = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    problem = object_problem(F.col("v"))
    told = parsed.withColumn("problem", F.coalesce(problem, check(F.col("v"))) if check else problem)
    bad = numbered(told.filter("problem IS NOT NULL").drop("v"), lines)
    return told.filter("problem IS NULL").drop("problem"), bad.select("file", "line", "problem", "value")
