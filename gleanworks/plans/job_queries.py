"""Queries that write: the jobs, each run twice into a new shared folder, and a stored snapshot that
is brought up to date. What then stands there is the result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators import crawling, harness, incremental
from gleanworks.operators.web import CrawlConfig
from gleanworks.sources.store import Store, bucket
from jobs import evaluate_search, index_documents

from .built import _DEPTH, _MOST, _SITE, _numbered
from .catalog import _CHUNK_ID, _CHUNKING, _DOCS, _PIECES, _ranked, query, read, text_documents


def _new_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="gleanworks-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(_PIECES + f""" SELECT chunk_id, source_path, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(char_start AS INTEGER) AS char_start,
  CAST(char_end AS INTEGER) AS char_end, sha256(piece) AS content_hash, lang, CAST(384 AS INTEGER) AS dimension
  FROM (SELECT *, {_CHUNK_ID} AS chunk_id FROM chunks) c JOIN (SELECT doc_id AS id, lang FROM documents) USING (id)""")
def job1_index_documents(spark: SparkSession, d: str) -> DataFrame:
    folder = _new_folder(spark, "job1")
    for _ in range(2):
        found = index_documents.run(spark, f"{d}/documents.parquet", f"{folder}/store", f"{folder}/checkpoint")
    return found.select("chunk_id", "source_path", "chunk_index", "char_start", "char_end", "content_hash", "lang", "dimension")


@query(f"""WITH top AS (
  SELECT query_id, label, asked, s, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM ({_ranked("vec_id <> query_id", 5)}))
SELECT q.vec_id AS query_id, q.label, count(t.vec_id) AS found, count(*) FILTER (t.label = q.label) AS relevant,
  CAST(min(place) FILTER (t.label = q.label) AS INTEGER) AS first_relevant, max(t.vec_id) FILTER (place = 1) AS best_id, max(round(s, 6)) FILTER (place = 1) AS best_score
FROM embeddings q LEFT JOIN top t ON t.query_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, q.label""")
def job2_evaluate_search(spark: SparkSession, d: str) -> DataFrame:
    folder = _new_folder(spark, "job2")
    for _ in range(2):
        found = evaluate_search.run(spark, f"{d}/embeddings.parquet", folder)
    return found


#: Of each 1009 documents one has changed since the stored snapshot, one is gone and one is new.
@query(f"""WITH d AS (SELECT source_path, content_hash, id % 1009 AS r, CAST(CAST('0x' || substr(sha256(source_path), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket FROM ({_DOCS}))
SELECT source_path, bucket, content_hash, bucket IN (SELECT bucket FROM d WHERE r IN (5, 6, 7)) AS rewritten FROM d WHERE r <> 6""")
def incremental_buckets(spark: SparkSession, d: str) -> DataFrame:
    """A stored snapshot brought up to date: only the buckets of sources that differ are written anew."""
    store = Store(spark, _new_folder(spark, "store"), 64)
    docs, r = text_documents(spark, d).select("id", "source_path", "content_hash", "ingestion_fingerprint"), F.col("id") % 1009
    stated = docs.withColumns({"chunking_fingerprint": F.lit(_CHUNKING), "chunk_count": F.lit(1)})
    store.write({"documents": stated.filter(r != 7).withColumn("content_hash", F.when(r == 5, F.lit("0")).otherwise(F.col("content_hash"))).drop("id")}, 0)
    past = store.read("documents")
    counts = past.select("source_path", F.lit(1).cast("long").alias("chunks"))
    found = docs.filter(r != 6).drop("id").withColumn("error", F.lit(None).cast("string"))
    classes = incremental.classify(found, past, counts, "/docs", _CHUNKING)
    touched = [x.b for x in classes.filter("status <> 'unchanged'").select(bucket(F.col("source_path"), 64).alias("b")).distinct().collect()]
    store.write({"documents": incremental.merge(store.read("documents", touched), stated.filter(r != 6).drop("id"), classes)}, 1, {"documents": touched})
    fresh = [int(b) for b, p in store.current()["tables"]["documents"]["at"].items() if p.startswith("data/00000002-")]
    where = bucket(F.col("source_path"), 64)
    return store.read("documents").select("source_path", where.alias("bucket"), "content_hash", where.isin(fresh).alias("rewritten"))


#: A task a document: as many points as its length says, labels unless its text asks, and some lines that are cut or no objects.
_TASK_LINE = """CASE WHEN n_chars % 17 = 0 THEN '{{"id": "cut' WHEN n_chars % 19 = 0 THEN '[' || n_chars || ']' ELSE
  '{{"id": "' || CASE WHEN n_chars % 23 = 0 THEN doc_id % 10 ELSE doc_id END || CASE WHEN n_chars % 23 = 0 THEN '' ELSE 'd' END || '", "query": ' || CASE WHEN n_chars % 29 = 0 THEN '7' ELSE '"q"' END ||
  CASE WHEN n_chars % 31 = 0 THEN ', "auto": null' ELSE ', "auto": true' END || CASE WHEN n_chars % 5 = 0 THEN ', "task_type": "refusal"' ELSE '' END ||
  CASE WHEN {ends} THEN '' ELSE ', "relevant_source_paths": ["/docs/x"]' END || ', "expected_points": [' || {points} || ']}}' END"""
_SPARK_TASK = _TASK_LINE.format(ends="text LIKE '%.'", points="array_join(transform(sequence(0, int(n_chars % 12)), i -> CASE WHEN i = 0 THEN '\"p\"' ELSE ', \"p\"' END), '')")
_SQL_TASK = """CASE WHEN n_chars % 17 = 0 THEN 'not JSON' WHEN n_chars % 19 = 0 THEN 'not an object' WHEN n_chars % 29 = 0 THEN 'query'
  WHEN n_chars % 5 <> 0 AND text LIKE '%.' THEN 'no label' WHEN n_chars % 12 + 1 > 8 THEN 'expected_points' WHEN n_chars % 31 = 0 THEN 'auto' END"""


@query(f"""WITH t AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS line, {_SQL_TASK} AS problem, CASE WHEN n_chars % 23 = 0 THEN doc_id % 10 ELSE doc_id + 100 END AS id
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY id, problem IS NULL ORDER BY lang, line) AS k FROM t)
SELECT lang, line, coalesce(problem, 'repeated id') AS problem FROM r WHERE problem IS NOT NULL OR k > 1""")
def task_lines(spark: SparkSession, d: str) -> DataFrame:
    """Task files, one of each language, scanned: every line that breaks the contract, with its place."""
    folder = _new_folder(spark, "tasks")
    lines = spark.read.parquet(f"{d}/documents.parquet").selectExpr("lang", "doc_id", f"{_SPARK_TASK} AS value")
    lines.repartition("lang").sortWithinPartitions("lang", "doc_id").select("value", "lang").write.partitionBy("lang").text(folder)
    _, problems = harness.scan_tasks(spark, f"{folder}/*")
    return problems.select(F.regexp_extract("file", "lang=([^/]*)", 1).alias("lang"), "line", "problem")


@query(f"""WITH RECURSIVE site AS (SELECT (row_number() OVER (ORDER BY page_id) - 1) % 3 AS h, (row_number() OVER (ORDER BY page_id) - 1) // 3 AS i FROM pages),
walk(h, url, i, depth, path) AS (
  SELECT h, 'https://s' || h || '.example/s/0', 0, 0, [0] FROM (VALUES (0), (1), (2)) t(h)
  UNION ALL
  SELECT w.h, 'https://s' || w.h || CASE WHEN k = 1 THEN '.example/gone/' || w.i ELSE '.example/s/' || (2 * w.i + 1 + k // 2) END, CASE WHEN k = 1 THEN -1 ELSE 2 * w.i + 1 + k // 2 END, depth + 1, list_append(path, k)
  FROM walk w JOIN site s ON s.h = w.h AND s.i = w.i, (VALUES (0), (1), (2)) v(k) WHERE depth < {_DEPTH}),
ordered AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.h ORDER BY depth, path) AS pos,
    CASE WHEN w.h = 2 AND w.i < 0 THEN 'robots-disallowed' WHEN s.i IS NULL THEN 'failed' ELSE 'fetched' END AS status
  FROM walk w LEFT JOIN site s ON s.h = w.h AND s.i = w.i),
counted AS (
  SELECT *, coalesce(count(*) FILTER (status = 'fetched') OVER (PARTITION BY h ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    count(*) FILTER (status <> 'robots-disallowed') OVER (PARTITION BY h ORDER BY pos) - 1 AS waits FROM ordered)
SELECT url, depth, pos, status, CAST(waits * CASE h WHEN 1 THEN 3.0 ELSE 1.5 END AS DOUBLE) AS start FROM counted WHERE before < {_MOST}""")
def crawl_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Three sites at once, by host, with robots rules and the times at which their pages are due."""
    n, h = F.expr("i div 3"), F.expr("i % 3")
    pages = _numbered(read(spark, d, "pages").select("page_id")).select(h.alias("h"), n.alias("i")).selectExpr("'https://s' || h || '.example/s/' || i AS url", f"{_SITE} AS html")
    rules = spark.createDataFrame([("s1.example", "User-agent: *\nCrawl-delay: 3"), ("s2.example", "User-agent: *\nDisallow: /gone")], "host string, robots string")
    starts = [f"https://s{k}.example/s/0" for k in range(3)]
    found = crawling.crawl_sites(spark, starts, crawling.stored(pages), _new_folder(spark, "crawl"), CrawlConfig(_MOST, _DEPTH, 1.5), lambda hosts: hosts.join(rules, "host", "left").select("host", "robots"))
    return found.select("url", "depth", "pos", "status", "start")
