"""Measures how well exact vector search finds rows of a query's own label.

    python -m jobs.evaluate_search EMBEDDINGS OUTPUT [--config FILE]

Reads a table (vec_id, embedding, label); the rows that ``queries`` names ask for their ``k``
nearest others. Writes, each run over what was there:

* ``OUTPUT/results``, partitioned by label: for each query how many were found, how many of them have its
  label, the place of the first that has, and the best one found
* ``OUTPUT/report``: for each label the number of queries, the share with a relevant one, precision and
  mean reciprocal rank, as JSON lines

The result is a function of the table and the settings, so a run that was lost is simply run again.

Defined cases: a query doesn't find itself; equal scores rank by vec_id; a query without
length, or whose vector is null, has a row that found nothing; a null label is relevant to nothing
and has a partition of its own; rows with null vec_id or vector are never found; an empty table
gives empty outputs.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanworks.operators import index

log = logging.getLogger("jobs.evaluate_search")

CONFIG = Path(__file__).with_suffix(".json")
RESULTS = "query_id long, found long, relevant long, first_relevant int, best_id long, best_score double, label int"


def results(embeddings: DataFrame, config: dict) -> DataFrame:
    """A row for each query."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vector")).filter("vec_id IS NOT NULL")
    asked = rows.filter(config["queries"]).select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"), F.col("vector").alias("query_vector"))
    near = index.search(rows.filter("vector IS NOT NULL"), asked.filter("query_vector IS NOT NULL"), config["k"] + 1, config["min_score"], id_col="vec_id").filter("vec_id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= config["k"])
    met = asked.select("query_id", "asked").join(top.join(rows.select("vec_id", "label"), "vec_id"), "query_id", "left")
    same = F.col("label") == F.col("asked")
    first = F.col("place") == 1
    each = met.groupBy("query_id", "asked").agg(
        F.count("vec_id").alias("found"),
        F.count_if(F.coalesce(same, F.lit(False))).alias("relevant"),
        F.min(F.when(same, F.col("place"))).alias("first_relevant"),
        F.max(F.when(first, F.col("vec_id"))).alias("best_id"),
        F.max(F.when(first, F.round("score", 6))).alias("best_score"),
    )
    return each.withColumnRenamed("asked", "label")


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("label").agg(
        F.count("*").alias("queries"),
        F.avg((F.col("relevant") > 0).cast("double")).alias("recall_at_k"),
        F.avg(F.when(F.col("found") > 0, F.col("relevant") / F.col("found")).otherwise(0.0)).alias("precision"),
        F.avg(F.coalesce(1 / F.col("first_relevant"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def run(spark: SparkSession, embeddings: str, output: str, config: dict | None = None) -> DataFrame:
    """Writes both outputs; returns the results as they stand then."""
    config = json.loads(CONFIG.read_text()) | (config or {})
    output = output.rstrip("/")
    table = spark.read.parquet(embeddings)
    names = [c.split()[0] for c in RESULTS.split(", ")]
    # Labels are few and may be uneven: rebalanced partitions are split by size.
    results(table, config).select(names).hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(f"{output}/results")
    back = spark.read.schema(RESULTS).parquet(f"{output}/results").select(names)
    report(back).coalesce(1).orderBy("label").write.mode("overwrite").json(f"{output}/report")
    log.info("%s: read %d rows, wrote %d results to %s", embeddings, table.count(), back.count(), output)
    return back


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("jobs.evaluate_search", description=__doc__.splitlines()[0])
    p.add_argument("embeddings")
    p.add_argument("output")
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_search").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.embeddings, args.output, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
