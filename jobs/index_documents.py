"""Keeps a searchable store of evidence up to date with a growing table of documents.

    python -m jobs.index_documents DOCUMENTS OUTPUT CHECKPOINT [--config FILE]

A file stream takes each file of the table once (availableNow; the checkpoint says which are
done). Of each batch only documents that are new or have changed are chunked and embedded:

* ``OUTPUT/manifest``, partitioned by batch: a row for each such document and what happened to it
* ``OUTPUT/chunks``, partitioned by batch and bucket: its chunks with their vectors

A batch looks only at the batches before it and writes only its own partitions (dynamic
overwrite), the manifest last; so one that is taken again, after a loss, gives the same files.
``current`` reads the latest version of each document.

Defined cases: a document's path comes from source and doc_id; a null source is an empty one; a row
without doc_id is rejected (status ``rejected``, no chunks); a null text removes a document; a text
without words stays a document without chunks; of several rows of a batch with one path the one
with the greatest content hash counts; other settings than last time (chunk sizes, dimension) make
every document of the files that are new changed, those taken before stay as they are; a file
that is rewritten under its name isn't seen again; columns besides doc_id, text, lang and source
are not read; an empty table gives an empty store.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.functions import identity
from gleanworks.functions.embedders import hash_embedder
from gleanworks.operators import chunking, index

log = logging.getLogger("jobs.index_documents")

CONFIG = Path(__file__).with_suffix(".json")
#: Bytes of text that a task cuts, embeds and writes, about.
TASK_BYTES = 16 << 20
MANIFEST = "source_path string, source_id string, doc_id string, content_hash string, lang string, n_chars long, settings string, status string, batch long"
CHUNKS = "chunk_id string, doc_id string, source_path string, text string, chunk_index int, content_hash string, char_start int, char_end int, vector array<double>, norm double, batch long, bucket int"


def _named(rows: DataFrame) -> DataFrame:
    """Rows of documents with their paths and the hashes of their texts."""
    path = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("/docs/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return rows.select(path.alias("source_path"), identity.sha256(F.col("text")).alias("content_hash"), "lang", F.length("text").cast("long").alias("n_chars"), "text")


def _files(named: DataFrame, settings: str, value: str, *by: str) -> DataFrame:
    """Text files with their identities and ``value``, one for each path. Equal hashes have equal texts, so that lang decides between them."""
    found = named.groupBy("source_path", *by).agg(F.max(F.struct("content_hash", "lang", value)).alias("v")).select("source_path", "v.*")
    found = found.withColumn("source_id", identity.source_id(F.col("source_path")))
    return found.withColumns({"doc_id": identity.document_id(F.col("source_id"), F.col("content_hash")), "settings": F.lit(settings)})


def _with_status(files: DataFrame, past: DataFrame) -> DataFrame:
    """Files that are new or have changed since the manifest ``past``, or are gone."""
    past = _latest(past).select("source_path", F.col("content_hash").alias("past_hash"), F.col("settings").alias("past_settings"), F.col("status").alias("past_status"))
    known = F.col("past_status").isNotNull() & (F.col("past_status") != "removed")
    status = (
        F.when(F.col("source_path").isNull(), "rejected")
        .when(F.col("content_hash").isNull(), F.when(known, "removed").otherwise("absent"))
        .when(~F.coalesce(known, F.lit(False)), "added")
        .when((F.col("content_hash") == F.col("past_hash")) & (F.col("settings") == F.col("past_settings")), "unchanged")
        .otherwise("updated")
    )
    return files.join(past, "source_path", "left").withColumn("status", status).filter("status NOT IN ('unchanged', 'absent')")


def _chunks(files: DataFrame, config: chunking.ChunkConfig) -> DataFrame:
    """Chunks of files, each of which is one block."""
    fixed = {
        "file_type": F.lit("txt"), "ingestion_fingerprint": F.lit(identity.ingestion_fingerprint("txt")), "block_pos": F.lit(0), "extraction_method": F.lit("text"), "page_number": F.lit(None).cast("int"),
        "heading_path": F.array().cast("array<string>"), "normalized_char_start": F.lit(0), "warnings": F.array().cast("array<string>"),
    }
    made = chunking.chunk_blocks(files.withColumns(fixed), config, one_block=True)
    return made.withColumnsRenamed({"normalized_char_start": "char_start", "normalized_char_end": "char_end"})


def _table(spark: SparkSession, path: str, schema: str, *parts: str) -> DataFrame:
    """A partitioned table; where there is none, an empty one is begun."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*parts).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _latest(manifest: DataFrame) -> DataFrame:
    names = [c for c in manifest.columns if c not in ("source_path", "batch")]
    return manifest.filter("status <> 'rejected'").groupBy("source_path").agg(F.max(F.struct("batch", *names)).alias("m")).select("source_path", "m.*")


def take(batch: DataFrame, n: int, output: str, config: dict) -> None:
    """Batch ``n``: what is new or has changed since the batches before.

    Texts are shuffled once, by path, and a task cuts, embeds and writes what it got: vectors, which are
    larger, aren't moved. A bucket is the same hash, so each task writes into one. The manifest needs no texts.
    """
    spark = batch.sparkSession
    cut, embedder = chunking.ChunkConfig(config["max_chars"], config["overlap_chars"]), hash_embedder(config["dimension"])
    settings = f"{cut.fingerprint}|{embedder.fingerprint}"
    rows = batch.select("doc_id", "text", "lang", "source")
    read = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    tasks = config["buckets"] * max(1, -(-read["bytes"] // (config["buckets"] * TASK_BYTES)))
    named, past = _named(rows), _table(spark, f"{output}/manifest", MANIFEST, "batch").filter(F.col("batch") < n)
    # Of a path's rows, those without a text count for the manifest only: they have the least hash.
    texts = _files(named.filter("source_path IS NOT NULL AND text IS NOT NULL").repartition(tasks, "source_path"), settings, "text")
    chunks = index.build(_chunks(_with_status(texts, past.repartition(tasks, "source_path")), cut), embedder)
    kept = [c.split()[0] for c in CHUNKS.split(", ") if not c.startswith(("batch", "bucket"))]
    made = chunks.select(*kept, F.lit(n).cast("long").alias("batch"), F.pmod(F.hash("source_path"), F.lit(config["buckets"])).alias("bucket"))
    # Rows without a path are kept one by one.
    lost = F.when(F.col("source_path").isNull(), F.monotonically_increasing_id())
    changed = _with_status(_files(named.withColumn("lost", lost), settings, "n_chars", "lost"), past).withColumn("batch", F.lit(n).cast("long"))
    _table(spark, f"{output}/chunks", CHUNKS, "batch", "bucket")
    for df, name, parts in ((made, "chunks", ("batch", "bucket")), (changed.select(*(c.split()[0] for c in MANIFEST.split(", "))), "manifest", ("batch",))):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{output}/{name}")
    done = spark.read.schema(MANIFEST).parquet(f"{output}/manifest").filter(F.col("batch") == n).groupBy("status").count().orderBy("status").collect()  # five kinds at most
    log.info("batch %d: read %d rows, wrote %d chunks of %s to %s", n, read["rows"], spark.read.schema(CHUNKS).parquet(f"{output}/chunks").filter(F.col("batch") == n).count(), {r["status"]: r["count"] for r in done}, output)


def _streamable(spark: SparkSession, path: str) -> str:
    """A file source takes a folder, or a pattern: a table that is one file is given as a pattern of one."""
    try:
        spark.read.parquet(f"{path}/*")
        return path
    except AnalysisException:  # nothing in it: no folder, or an empty one
        return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes the files of ``documents`` that are new; returns the whole store as it stands then."""
    config = json.loads(CONFIG.read_text()) | (config or {})
    documents, output = documents.rstrip("/"), output.rstrip("/")
    schema = spark.read.parquet(documents).schema
    # The source would forget files older than a week beside newer ones.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).option("maxFileAge", "36500d").parquet(_streamable(spark, documents))
    started = stream.writeStream.foreachBatch(lambda batch, n: take(batch, n, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    log.info("%s: %d batches taken", documents, sum(p.numInputRows > 0 for p in started.recentProgress))
    return current(spark, output)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the latest version of each document, with its lang. Vectors are measured before the join, which moves them only for who asks for them."""
    last = _latest(_table(spark, f"{output}/manifest", MANIFEST, "batch")).filter("status <> 'removed'").select("source_path", "batch", "lang")
    chunks = _table(spark, f"{output}/chunks", CHUNKS, "batch", "bucket").withColumn("dimension", F.size("vector"))
    return chunks.join(last, ["source_path", "batch"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("jobs.index_documents", description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_documents").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.documents, args.output, args.checkpoint, json.loads(Path(args.config).read_text()))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
