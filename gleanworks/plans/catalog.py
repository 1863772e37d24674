"""Queries by name, each with DuckDB SQL for the same result where SQL can express it.

Inputs that the tables lack (audits of answers, judge outputs, old snapshots)
are derived from their ids by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, text, vector
from ..functions.embedders import hash_embedder, word_feature_counts
from ..operators import agent, answering, chunking, evaluation, harness, incremental, index, web
from ..sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectors: rows whose id is divisible by 50 are the queries

_COSINE = "round(list_cosine_similarity(CAST(i.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12)"
_SCORED = f"SELECT q.vec_id AS query_id, i.vec_id, i.label, q.label AS asked, {_COSINE} AS s FROM embeddings i, embeddings q WHERE q.vec_id % 50 = 0"


def _ranked(where: str = "TRUE", k: int = 5) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ({_SCORED}) WHERE {where}) WHERE rank <= {k}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("label").alias("asked"))


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ({_ranked()})")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return _hits(index.search(rows, asked, 5, id_col="vec_id"))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ({_ranked('label = 1')})")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return _hits(index.search(rows, asked, 5, where=F.col("label") == 1, id_col="vec_id"))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ({_ranked('s >= 0.3', 20)})")
def vector_topk_min_score(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return _hits(index.search(rows, asked, 20, 0.3, id_col="vec_id"))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM ({_ranked('query_id <> vec_id', 3).replace(' WHERE q.vec_id % 50 = 0', '')})")
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """All rows as queries, in blocks of both sides where they are too many to be sent."""
    rows, _ = _vectors(spark, d)
    found = index.search(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector")), 4, id_col="vec_id").filter("vec_id <> query_id")
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return _hits(found.withColumn("rank", F.row_number().over(again)).filter("rank <= 3"))


@query(f"""SELECT count(*) AS queries, avg(hit) AS recall_at_k, avg(share) AS citation_accuracy FROM (
  SELECT query_id, max(CASE WHEN label = asked THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN label = asked THEN 1.0 ELSE 0.0 END) AS share
  FROM ({_ranked("vec_id <> query_id")}) GROUP BY query_id)""")
def vector_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Labels as relevance; a query doesn't find itself."""
    rows, asked = _vectors(spark, d)
    found = index.search(rows, asked, 6, id_col="vec_id").filter("vec_id <> query_id")
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(again)).filter("rank <= 5")
    met = top.join(rows.select("vec_id", "label"), "vec_id").join(asked.select("query_id", "asked"), "query_id")
    each = met.groupBy("query_id").agg(F.max((F.col("label") == F.col("asked")).cast("double")).alias("hit"), F.avg((F.col("label") == F.col("asked")).cast("double")).alias("share"))
    return each.agg(F.count("*").alias("queries"), F.avg("hit").alias("recall_at_k"), F.avg("share").alias("citation_accuracy"))


@query("""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS blank_ids, count(vec_id) - count(DISTINCT vec_id) AS repeated_ids,
  count(*) FILTER (len(embedding) <> 64) AS wrong_size, count(*) FILTER (list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) > 0) AS not_finite,
  count(DISTINCT len(embedding)) AS dimensions FROM embeddings""")
def vector_norm_validate(spark: SparkSession, d: str) -> DataFrame:
    return index.check_rows(_vectors(spark, d)[0].withColumnRenamed("vec_id", "chunk_id"), 64)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 9) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d)[0].select("vec_id", F.round(vector.norm(F.col("vector")), 9).alias("norm"))


# ---- documents, chunks, manifests

_CHUNKING = identity.chunking_fingerprint()
_INGESTION = identity.ingestion_fingerprint("txt")
_DOCS = """SELECT doc_id AS id, text, source_path, sha256('source:v1:' || source_path) AS source_id, sha256(text) AS content_hash,
  sha256('document:v1:' || sha256('source:v1:' || source_path) || '|' || sha256(text)) AS doc_id
  FROM (SELECT doc_id, text, '/docs/' || source || '/' || doc_id || '.txt' AS source_path FROM documents)"""
_BOUNDARY = "(?s)^.*[\\n。！？；.!?; ]"
_PIECES = rf"""WITH RECURSIVE docs AS ({_DOCS}),
walk(id, s, n, st, en) AS (
  SELECT id, s, length(s), 0, CASE WHEN 1200 < length(s) THEN coalesce(nullif(600 + length(regexp_extract(substr(s, 601, 600), E'(?s)^.*[\n。！？；.!?; ]')), 600), 1200) ELSE length(s) END
  FROM (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM docs) WHERE length(s) > 0
  UNION ALL
  SELECT id, s, n, b, CASE WHEN b + 1200 < n THEN b + coalesce(nullif(600 + length(regexp_extract(substr(s, b + 601, 600), E'(?s)^.*[\n。！？；.!?; ]')), 600), 1200) ELSE n END
  FROM (SELECT id, s, n, greatest(en - 120, st + 1) AS b, en FROM walk) WHERE en < n),
pieces AS (
  SELECT id, st, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS piece, st + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS a
  FROM (SELECT id, st, substr(s, st + 1, en - st) AS raw FROM walk)),
chunks AS (
  SELECT d.*, row_number() OVER (PARTITION BY id ORDER BY st) - 1 AS chunk_index, piece, a AS char_start, a + length(piece) AS char_end
  FROM pieces JOIN docs d USING (id) WHERE piece <> '')"""


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """`documents` as text files: one block each."""
    path = F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", path.alias("source_path"))
    rows = rows.withColumns({"source_id": identity.source_id(F.col("source_path")), "content_hash": identity.sha256(F.col("text"))})
    return rows.withColumns({"doc_id": identity.document_id(F.col("source_id"), F.col("content_hash")), "file_type": F.lit("txt"), "ingestion_fingerprint": F.lit(_INGESTION), "warnings": F.array().cast("array<string>")})


def text_blocks(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"block_pos": F.lit(0), "extraction_method": F.lit("text"), "page_number": F.lit(None).cast("int"), "heading_path": F.array().cast("array<string>"), "normalized_char_start": F.lit(0), "encoding": F.lit("utf-8-sig")})


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_blocks(text_blocks(text_documents(spark, d)))


@query(f"SELECT source_path, source_id, content_hash, doc_id FROM ({_DOCS})")
def doc_identity(spark: SparkSession, d: str) -> DataFrame:
    return text_documents(spark, d).select("source_path", "source_id", "content_hash", "doc_id")


@query(_PIECES + " SELECT source_path, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, sha256(piece) AS content_hash FROM chunks")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return text_chunks(spark, d).select("source_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("normalized_char_start").cast("long").alias("char_start"), F.col("normalized_char_end").cast("long").alias("char_end"), "content_hash")


_CHUNK_ID = f"sha256('chunk:v2|' || source_id || '|' || doc_id || '|' || content_hash || '|' || chunk_index || '|' || sha256(piece) || '|{_INGESTION}|{_CHUNKING}')"


@query(_PIECES + f" SELECT {_CHUNK_ID} AS chunk_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return text_chunks(spark, d).select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(_PIECES + " SELECT d.doc_id, d.source_path, CAST(1 AS BIGINT) AS block_count, count(c.piece) AS chunk_count, 'text' AS methods, 'utf-8-sig' AS encodings, CAST(0 AS INTEGER) AS pages FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL")
def doc_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = text_documents(spark, d)
    blocks = text_blocks(docs)
    found = chunking.manifest(docs, blocks, chunking.chunk_blocks(blocks))
    return found.select("doc_id", "source_path", "block_count", "chunk_count", F.array_join("extraction_methods", ",").alias("methods"), F.array_join("encodings", ",").alias("encodings"), F.size("pages").alias("pages"))


_STATS = "words long, pairs long, triples long, weight double"


def _feature_stats(texts: list[str | None]) -> pa.Array:
    counted = [word_feature_counts((t or "").lower()) for t in texts]
    return pa.array([{"words": w, "pairs": p, "triples": t, "weight": x} for w, p, t, x in counted], pa.struct([*((k, pa.int64()) for k in ("words", "pairs", "triples")), ("weight", pa.float64())]))


@query(r"""SELECT doc_id, CAST(count(w) AS BIGINT) AS words, CAST(coalesce(sum(CASE WHEN length(w) > 1 THEN length(w) - 1 END), 0) AS BIGINT) AS pairs,
  CAST(coalesce(sum(CASE WHEN length(w) > 2 THEN length(w) - 2 END), 0) AS BIGINT) AS triples,
  round(coalesce(sum(1 + CASE WHEN length(w) > 1 THEN 0.65 * (length(w) - 1) ELSE 0 END + CASE WHEN length(w) > 2 THEN 0.65 * (length(w) - 2) ELSE 0 END), 0)::DOUBLE, 4) AS weight
  FROM documents LEFT JOIN LATERAL (SELECT unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w) ON TRUE GROUP BY doc_id""")
def chunk_features_stats(spark: SparkSession, d: str) -> DataFrame:
    """Features of whole documents: how many of each kind, and their weight."""

    @F.arrow_udf(_STATS)
    def stats(texts: pa.Array) -> pa.Array:
        return text.by_slices(_feature_stats, _feature_stats([]).type, texts)

    got = read(spark, d, "documents").select("doc_id", stats("text").alias("f"))
    return got.select("doc_id", "f.words", "f.pairs", "f.triples", F.round("f.weight", 4).alias("weight"))


def _text_search(spark: SparkSession, d: str, k: int = 5, least: float = 0.08) -> tuple[DataFrame, DataFrame]:
    embedder = hash_embedder()
    chunks = text_chunks(spark, d)
    rows = chunks.filter(text.strip(F.col("text")) != "")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embedder.column(F.col("text")).alias("query_vector"))
    return index.search_results(index.search(rows, asked, k, least, embedder=embedder), chunks), asked


@query()
def text_search_topk(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _text_search(spark, d)
    return found.select("query_id", "rank", "chunk_id", "source_path", F.round("score", 6).alias("score"))


def holders(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id with the source_path of each document that holds the item's text: an
    equi-join on the item's first four words, then the exact test."""
    gram = lambda w, i: F.array_join(F.slice(w, i + 1, 4), " ")
    first = items.select("item_id", F.col("text").alias("item"), gram(F.split(text.strip(F.col("text")), "\\s+"), F.lit(0)).alias("gram"))
    worded = docs.select("source_path", F.split(text.strip(F.col("text")), "\\s+").alias("words"))
    grams = worded.select("source_path", F.explode(F.array_distinct(F.transform("words", lambda _, i: gram(F.col("words"), i)))).alias("gram"))
    likely = first.join(grams, "gram").select("item_id", "item", "source_path")
    return likely.join(docs.select("source_path", "text"), "source_path").filter(F.contains("text", F.col("item"))).select("item_id", "source_path")


@query()
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as queries; relevant are the documents that hold them."""
    found, _ = _text_search(spark, d)
    items = read(spark, d, "benchmark")
    docs = text_documents(spark, d)
    held = holders(items, docs).groupBy("item_id").agg(F.collect_set("source_path").alias("relevant_source_paths"))
    rows = items.join(held, "item_id").select(F.col("item_id").alias("ordinal"), F.lit(None).cast("string").alias("name"), F.col("text").alias("query"), F.array().cast("array<string>").alias("relevant_chunk_ids"), "relevant_source_paths", F.lit(None).cast("double").alias("min_score"))
    return evaluation.report(evaluation.sample_results(evaluation.samples(rows).filter("problem IS NULL"), found))


@query()
def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _text_search(spark, d)
    return answering.evidence_context(found, 2000)


# ---- incremental: an old snapshot lacks ids 3 mod 10, has other hashes for 4, and has ids 7 that are gone from disk

_CLASSES = """SELECT source_path, CASE WHEN r = 5 THEN 'failed' WHEN r = 7 THEN 'deleted' WHEN r = 3 THEN 'added' WHEN r = 4 THEN 'updated' ELSE 'unchanged' END AS status, r
  FROM (SELECT '/docs/' || source || '/' || doc_id || '.txt' AS source_path, doc_id % 10 AS r FROM documents)"""


def _snapshots(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = text_documents(spark, d)
    r = F.col("id") % 10
    files = docs.filter(r != 7).select("source_path", "content_hash", "ingestion_fingerprint", F.when(r == 5, F.lit("unreadable")).alias("error"))
    old = docs.filter(r != 3).select("source_path", F.when(r == 4, F.lit("0")).otherwise(F.col("content_hash")).alias("content_hash"), "ingestion_fingerprint", F.lit(_CHUNKING).alias("chunking_fingerprint"), F.lit(1).alias("chunk_count"))
    counts = old.select("source_path", F.lit(1).cast("long").alias("chunks"))
    classes = incremental.classify(files, old, counts, "/docs", _CHUNKING)
    return {"files": files, "old": old, "classes": classes, "new": docs.filter((r != 7) & (r != 5)).select("source_path", "content_hash")}


@query(f"SELECT source_path, status FROM ({_CLASSES})")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return _snapshots(spark, d)["classes"].select("source_path", "status")


@query(f"""SELECT count(*) FILTER (status = 'added') AS documents_added, count(*) FILTER (status = 'updated') AS documents_updated,
  count(*) FILTER (status = 'unchanged') AS documents_unchanged, count(*) FILTER (status = 'deleted') AS documents_deleted,
  count(*) FILTER (status = 'failed') AS documents_failed, count(*) FILTER (status = 'unchanged') AS chunks_reused,
  count(*) FILTER (status IN ('added', 'updated')) AS chunks_generated FROM ({_CLASSES})""")
def incremental_counters(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d)
    return incremental.counters(s["classes"], s["new"])


@query(f"""SELECT c.source_path, CASE WHEN status IN ('added', 'updated') THEN 'new' ELSE 'old' END AS version FROM ({_CLASSES}) c WHERE status <> 'deleted'""")
def chunk_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshots(spark, d)
    return incremental.merge(s["old"].select("source_path", F.lit("old").alias("version")), s["new"].select("source_path", F.lit("new").alias("version")), s["classes"])


@query("SELECT count(*) FILTER (doc_id % 3 = 0 AND doc_id % 5 <> 0) AS reused, count(*) FILTER (NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)) AS embedded FROM documents")
def vector_reuse_stats(spark: SparkSession, d: str) -> DataFrame:
    """The old index has ids 0 mod 3; of those, texts of ids 0 mod 5 have changed."""
    docs = text_documents(spark, d).select("id", F.col("doc_id").alias("chunk_id"), "text", "content_hash", "ingestion_fingerprint", F.lit(_CHUNKING).alias("chunking_fingerprint"))
    old = docs.filter("id % 3 = 0").withColumns({"text": F.when(F.col("id") % 5 == 0, F.lit("?")).otherwise(F.col("text")), "vector": F.array(F.lit(1.0))}).drop("id")
    met = index.reusable(docs.drop("id"), old)
    return index.update_stats(met.withColumn("reused", F.col("old_vector").isNotNull()))


# ---- web

_URL = "CASE WHEN regexp_matches(url, '^(?i)https?://[^/?#]+') THEN lower(regexp_extract(url, '^([^/]*//[^/?#]+)', 1)) || regexp_extract(url, '^[^/]*//[^/?#]+([^#]*)', 1) END"


@query(f"SELECT page_id, {_URL} AS url, sha256('source:v1:' || {_URL}) AS source_id FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    url = web.normalize_url(F.col("url"))
    return read(spark, d, "pages").select("page_id", url.alias("url"), identity.source_id(url).alias("source_id"))


@query("SELECT count(*) FILTER (m = 0) AS added, count(*) FILTER (m = 1) AS updated, count(*) FILTER (m > 1) AS unchanged FROM (SELECT page_id % 4 AS m FROM pages)")
def web_merge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages against an older crawl that lacks ids 0 mod 4 and has other content for 1 mod 4."""
    fp = F.lit(identity.ingestion_fingerprint("html"))
    rows = read(spark, d, "pages").select("page_id", F.concat(web.normalize_url(F.col("url")), F.lit("#"), F.col("page_id").cast("string")).alias("source_path"), identity.sha256(F.col("html")).alias("content_hash"), fp.alias("ingestion_fingerprint"))
    old = rows.filter("page_id % 4 <> 0").withColumns({"content_hash": F.when(F.col("page_id") % 4 == 1, F.lit("0")).otherwise(F.col("content_hash")), "ordinal": F.lit(1)})
    return web.merge_counts(rows, old)


@query("""SELECT source_path, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM (SELECT page_id, url || '#' || page_id AS source_path FROM pages)""")
def web_merge_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("source_path"))
    return web.merge_rows(rows.select("source_path", F.lit("old").alias("version")), rows.filter("page_id % 3 = 0").select("source_path", F.lit("new").alias("version")))


#: The references that SQL decodes, the ampersand's last, and what they stand for; as in HTML, the semicolon may be missing.
_REFERENCES = {"quot": "chr(34)", "lt": "'<'", "gt": "'>'", "amp": "'&'"}
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _name, _char in _REFERENCES.items():
    _TITLE = f"regexp_replace({_TITLE}, '&{_name};?', {_char}, 'g')"


def _decoded(expr: str) -> str:
    for name, char in _REFERENCES.items():
        expr = f"regexp_replace({expr}, '&{name};?', {char}, 'g')"
    return expr


_FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
#: Tags and texts of each article in order. A paragraph's end closes the nearest one that is open, or does nothing;
#: the outermost paragraphs are the blocks, below the title and the heading before them.
_BLOCKS_SQL = rf"""WITH t AS (
  SELECT page_id, {_FLAT.format(_TITLE)} AS title, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i
  FROM (SELECT page_id, html, regexp_extract_all(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<[^>]*>|[^<]+') AS tokens FROM pages)),
s AS (SELECT *, sum(CASE token WHEN '<p>' THEN 1 WHEN '</p>' THEN -1 ELSE 0 END) OVER w AS s FROM t WINDOW w AS (PARTITION BY page_id ORDER BY i)),
c AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM s),
b AS (SELECT *, coalesce(lag(depth) OVER w, 0) = 0 AND depth = 1 AS opens, lag(token) OVER w = '<h1>' AND depth = 0 AS heads FROM c WINDOW w AS (PARTITION BY page_id ORDER BY i)),
u AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY page_id ORDER BY i) AS unit FROM b),
heads AS (SELECT page_id, {_FLAT.format(_decoded("any_value(token)"))} AS head FROM u WHERE heads GROUP BY page_id),
blocks AS (
  SELECT page_id, title, unit, {_FLAT.format(_decoded("string_agg(token, ' ' ORDER BY i)"))} AS block
  FROM u WHERE depth > 0 AND token NOT LIKE '<%' GROUP BY page_id, title, unit),
kept AS (
  SELECT *, length(block) AS n, row_number() OVER (PARTITION BY page_id ORDER BY unit) - 1 AS pos,
    coalesce(sum(length(block) + 2) OVER (PARTITION BY page_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM blocks WHERE block <> '')
SELECT page_id, CAST(pos AS INTEGER) AS block_pos, sha256(block) AS text_hash, concat_ws(' / ', coalesce(nullif(title, ''), head), head) AS path,
  CAST(start AS BIGINT) AS normalized_char_start, CAST(start + n AS BIGINT) AS normalized_char_end FROM kept LEFT JOIN heads USING (page_id)"""


@query(_BLOCKS_SQL)
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = html.page_blocks(read(spark, d, "pages").select("page_id", "html"), "page_id")
    return web.block_offsets(blocks.withColumnRenamed("page_id", "doc_id")).select(F.col("doc_id").alias("page_id"), "block_pos", F.sha2("text", 256).alias("text_hash"), F.array_join("heading_path", " / ").alias("path"), "normalized_char_start", "normalized_char_end")


@query(rf"SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """The titles of all pages, references decoded."""
    return html.page_documents(read(spark, d, "pages").select("page_id", "html")).select("page_id", "title")


@query("""SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(coalesce(sum(length(l) + 2) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)""")
def block_offsets(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_pos", "text"))
    return web.block_offsets(lines).select("doc_id", F.col("block_pos").cast("long").alias("line"), F.col("normalized_char_start").cast("long").alias("char_start"))


# ---- text functions

@query(r"SELECT doc_id, sha256(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS normalised FROM documents")
def newline_normalize(spark: SparkSession, d: str) -> DataFrame:
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return read(spark, d, "documents").select("doc_id", F.sha2(text.normalize_newlines(crlf), 256).alias("normalised"))


@query(r"""SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(1 + doc_id % 3 AS BIGINT) AS level, trim(regexp_replace(l, '\s+', ' ', 'g')) AS title FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '\S')""")
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    """Every line that isn't blank, written as a heading and read back."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l")).filter("l RLIKE '\\\\S'")
    marks = F.repeat(F.lit("#"), (F.col("doc_id") % 3 + 1).cast("int"))
    found = lines.withColumn("h", text.heading(F.concat(marks, F.lit(" "), F.col("l"), F.lit(" ##"))))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.col("h.level").cast("long").alias("level"), text.collapse(F.col("h.title")).alias("title"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substr(text, 1, 79), '\s+$', '') || '…' END AS cut FROM documents")
def safe_truncate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.safe_truncate(F.col("text"), F.lit(80)).alias("cut"))


# ---- audits: three runs of a task for each label row

_ANSWER = f"""CASE (doc_id + run_id * 3) % 8 WHEN 0 THEN '{answering.NO_EVIDENCE}' WHEN 1 THEN 'a [1]' WHEN 2 THEN 'b [1] and [2]' WHEN 3 THEN 'c [9]'
  WHEN 4 THEN 'd' WHEN 5 THEN '{harness.NARROW_MARKERS[0]}' WHEN 6 THEN '{harness.BROAD_MARKERS[4]}' ELSE 'e [0]' END"""
_AUDIT = {
    "task_type": "CASE WHEN toxic = 1 THEN 'refusal' ELSE 'answerable' END",
    "auto": "quality = 1",
    "answer": _ANSWER,
    "n": "(doc_id + run_id) % 3",
    "calls": "1 + doc_id % 2",
    "hit": "CASE WHEN toxic = 1 THEN NULL ELSE doc_id % 4 <> 0 END",
    "web": "doc_id % 2 = 1",
}
_AUDIT_SQL = "SELECT doc_id AS task_id, run_id, " + ", ".join(f"{e} AS {k}" for k, e in _AUDIT.items()) + " FROM labels, (SELECT unnest([0, 1, 2]) AS run_id)"
_LIKE = lambda markers: "(" + " OR ".join(f"contains(trim(answer), '{m}')" for m in markers) + ")"
_METRICS = f"""SELECT *, CASE WHEN refused OR n = 0 THEN 'not_applicable' WHEN len(cited) = 0 THEN 'uncited'
    WHEN list_min(cited) >= 1 AND list_max(cited) <= n THEN 'ok' ELSE 'invalid' END AS citation_status,
  CASE WHEN task_type = 'refusal' THEN refused ELSE NOT refused END AS refusal_correct
  FROM (SELECT *, trim(answer) = '{answering.NO_EVIDENCE}' OR CASE WHEN task_type = 'refusal' THEN {_LIKE(harness.BROAD_MARKERS)} ELSE n = 0 AND {_LIKE(harness.NARROW_MARKERS)} END AS refused,
    CAST(regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS BIGINT[]) AS cited FROM ({_AUDIT_SQL}))"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = read(spark, d, "labels").selectExpr("doc_id AS task_id", "doc_id", "quality", "toxic", f"{_AUDIT['task_type']} AS task_type", f"{_AUDIT['auto']} AS auto")
    return rows.withColumns({"relevant_chunk_ids": F.when(F.col("toxic") == 1, none).otherwise(F.array(F.concat(F.lit("c"), F.col("doc_id").cast("string")))), "relevant_source_paths": none})


def _audits(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").withColumn("run_id", F.explode(F.array(*map(F.lit, range(3)))))
    rows = rows.selectExpr("doc_id", "run_id", f"{_ANSWER} AS answer", f"{_AUDIT['n']} AS n", f"{_AUDIT['calls']} AS calls")
    item = F.struct(F.lit("local").alias("source_type"), F.lit("s").alias("source_path"), F.lit("t").alias("text"))
    found = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).otherwise("x")
    results = F.array(F.struct(found.alias("chunk_id"), F.lit("s").alias("source_path")))
    call = F.struct(F.lit(agent.SEARCH).alias("name"), results.alias("results"))
    fetch = F.struct(F.lit(agent.FETCH).alias("name"), results.alias("results"))
    return rows.select(F.col("doc_id").alias("task_id"), "run_id", "answer", F.array_repeat(item, F.col("n").cast("int")).alias("evidence"), F.when(F.col("calls") > 1, F.array(call, fetch)).otherwise(F.array(call)).alias("tool_calls"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return harness.task_metrics(_tasks(spark, d), _audits(spark, d))


@query(f"SELECT task_id, run_id, task_type, hit AS retrieval_hit, citation_status, refused, refusal_correct, CAST(calls AS BIGINT) AS tool_calls, web AS web_used FROM ({_METRICS})")
def harness_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).withColumn("tool_calls", F.col("tool_calls").cast("long"))


_SUMMARY = """count(*) AS count, round_even(count(*) FILTER (task_type = 'answerable' AND coalesce(hit, FALSE)) / nullif(count(*) FILTER (task_type = 'answerable'), 0), 4) AS retrieval_hit_rate,
  round_even(count(*) FILTER (refusal_correct) / count(*), 4) AS refusal_correct_rate, round_even(count(*) FILTER (citation_status = 'ok') / count(*), 4) AS citation_ok_rate,
  count(*) FILTER (citation_status = 'uncited') AS citation_uncited, count(*) FILTER (citation_status = 'invalid') AS citation_invalid,
  round_even(sum(calls) / count(*), 2) AS avg_tool_calls, count(*) FILTER (web) AS web_used_count"""
_LAST = f"(SELECT m.*, CASE WHEN auto THEN 'auto' ELSE 'human' END AS provenance, source AS category FROM ({_METRICS}) m JOIN documents d ON d.doc_id = m.task_id WHERE run_id = 2)"


@query(f"""WITH last AS {_LAST}, sets AS (
  SELECT 'overall' AS section, '' AS label, {_SUMMARY} FROM last UNION ALL
  SELECT 'by_type', task_type, {_SUMMARY} FROM last GROUP BY task_type UNION ALL
  SELECT 'by_provenance', provenance, {_SUMMARY} FROM last GROUP BY provenance UNION ALL
  SELECT 'by_category', category, {_SUMMARY} FROM last WHERE category <> '' GROUP BY category)
SELECT * REPLACE (coalesce(count, 0) AS count) FROM sets RIGHT JOIN (
  SELECT section, label FROM sets UNION VALUES ('overall', ''), ('by_type', 'answerable'), ('by_type', 'refusal'), ('by_provenance', 'auto'), ('by_provenance', 'human')) USING (section, label)""")
def harness_aggregate_sets(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("category"))
    last = _metrics(spark, d).filter("run_id = 2").join(_tasks(spark, d).select("task_id", "auto"), "task_id").join(sources, "task_id")
    return harness.aggregate_sets(last)


_RUNS = f"(SELECT run_id, {_SUMMARY} FROM ({_METRICS}) GROUP BY run_id)"
_MEAN_STD = ", ".join(f"round_even(avg({c}), 4) AS {c}_mean, round_even(stddev_pop({c}), 4) AS {c}_std" for c in ("retrieval_hit_rate", "refusal_correct_rate", "citation_ok_rate"))


@query(f"SELECT count(*) AS run_count, {_MEAN_STD} FROM {_RUNS}")
def harness_jitter(spark: SparkSession, d: str) -> DataFrame:
    return harness.jitter(_metrics(spark, d))


@query(f"SELECT task_id, array_to_string(list(CAST(refused AS VARCHAR) ORDER BY run_id), ',') AS states FROM ({_METRICS}) GROUP BY task_id HAVING count(DISTINCT refused) > 1")
def refusal_flips(spark: SparkSession, d: str) -> DataFrame:
    found = harness.refusal_flips(_metrics(spark, d))
    return found.select("task_id", F.array_join(F.transform("states", lambda x: x.cast("string")), ",").alias("states"))


@query(f"""WITH s AS {_RUNS}, o AS (SELECT * FROM s WHERE run_id = 0), n AS (SELECT * FROM s WHERE run_id = 2)
SELECT * FROM ({" UNION ALL ".join(f"SELECT '{k}' AS key, (SELECT {k} FROM o)::DOUBLE AS old, (SELECT {k} FROM n)::DOUBLE AS new" for k in harness.RATES)}) WHERE old IS NOT NULL OR new IS NOT NULL""")
def report_compare(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    side = lambda run: m.filter(F.col("run_id") == run).agg(*harness.summary_columns())
    return harness.compare_metrics(side(0), side(2))


@query(f"WITH m AS ({_METRICS}) SELECT a.task_id, a.refused AS was, b.refused AS now FROM m a JOIN m b ON a.task_id = b.task_id WHERE a.run_id = 0 AND b.run_id = 2 AND a.refused <> b.refused")
def report_refusal_flips(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return harness.compare_refusals(m.filter("run_id = 0"), m.filter("run_id = 2"))


# ---- judges: outputs derived from label rows; every sixth breaks the contract

_TYPE = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(harness.FAILURE_TYPES)) + " END"
_RAW = f"""CASE doc_id % 6 WHEN 0 THEN 'no object' WHEN 1 THEN concat('{{"faithfulness": 9, "coverage": 1, "overall": 1, "failure_type": "', {_TYPE}, '"}}')
  ELSE concat('Verdict: {{"faithfulness": ', 1 + doc_id % 5, ', "coverage": ', 1 + doc_id % 4, ', "overall": ', 1 + doc_id % 5, ', "failure_type": "', {_TYPE}, '", "reason": "r', doc_id, '"}} end') END"""
_VERDICTS = f"""SELECT doc_id AS task_id, CASE WHEN doc_id % 6 > 1 THEN 1 + doc_id % 5 END AS faithfulness, CASE WHEN doc_id % 6 > 1 THEN 1 + doc_id % 4 END AS coverage,
  CASE WHEN doc_id % 6 > 1 THEN 1 + doc_id % 5 END AS overall, CASE WHEN doc_id % 6 > 1 THEN {_TYPE} END AS failure_type, CASE WHEN doc_id % 6 > 1 THEN 'r' || doc_id END AS reason,
  CASE doc_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'faithfulness' END AS error, toxic, doc_id FROM labels"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return harness.parse_verdicts(read(spark, d, "labels").selectExpr("doc_id AS task_id", f"{_RAW} AS raw"))


@query(f"SELECT task_id, CAST(faithfulness AS INTEGER) AS faithfulness, CAST(coverage AS INTEGER) AS coverage, CAST(overall AS INTEGER) AS overall, failure_type, reason, error FROM ({_VERDICTS})")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"""SELECT count(*) FILTER (error IS NULL) AS judged_count, count(*) FILTER (error IS NOT NULL) AS judge_error_count,
  round_even(avg(overall), 4) AS overall_mean, round_even(avg(faithfulness), 4) AS faithfulness_mean, round_even(avg(coverage), 4) AS coverage_mean FROM ({_VERDICTS})""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return harness.judge_summary(_verdicts(spark, d))


@query(f"SELECT t AS failure_type, count(v.task_id) AS n FROM (SELECT unnest({harness.FAILURE_TYPES!r}) AS t) LEFT JOIN ({_VERDICTS}) v ON v.failure_type = t GROUP BY t")
def judge_failure_types(spark: SparkSession, d: str) -> DataFrame:
    return harness.failure_type_counts(_verdicts(spark, d))


@query(f"""SELECT *, judge_error_count > 0 OR coalesce(abs(mean_overall_delta) > 1, FALSE) OR type_mismatch_count > 2 AS warning FROM (
  SELECT count(*) AS sample_count, round_even(avg(overall - (1 + (doc_id + 1) % 5)), 4) AS mean_overall_delta,
    count(*) FILTER (error IS NULL AND failure_type <> '{harness.FAILURE_TYPES[0]}') AS type_mismatch_count, count(*) FILTER (error IS NOT NULL) AS judge_error_count FROM ({_VERDICTS}))""")
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    human = read(spark, d, "labels").selectExpr("doc_id AS task_id", "1 + (doc_id + 1) % 5 AS overall", f"'{harness.FAILURE_TYPES[0]}' AS failure_type")
    return harness.calibration(human, _verdicts(spark, d))


@query(f"""SELECT bucket, count(*) AS n, min(task_id) AS first, max(task_id) AS last FROM (
  SELECT task_id, CASE WHEN toxic = 1 THEN 'unlabeled' WHEN doc_id % 4 <> 0 AND overall >= 3 THEN 'hit_and_high' WHEN doc_id % 4 <> 0 THEN 'hit_and_low'
    WHEN overall < 3 THEN 'miss_and_low' ELSE 'miss_and_high' END AS bucket FROM ({_VERDICTS}) WHERE error IS NULL) GROUP BY bucket""")
def cross_attribution(spark: SparkSession, d: str) -> DataFrame:
    found = harness.cross_attribution(_metrics(spark, d).filter("run_id = 2"), _verdicts(spark, d))
    return found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("task_id").alias("first"), F.max("task_id").alias("last"))


@query(f"""SELECT query_id AS task_id, round(max(s), 6) AS max_score, count(*) AS evidence_count, CASE WHEN max(s) >= 0.15 THEN '{harness.IDEAL_ANSWER}' ELSE '{answering.NO_EVIDENCE}' END AS answer
  FROM ({_ranked("vec_id <> query_id AND s >= 0.08", 5)}) GROUP BY query_id
  UNION ALL SELECT vec_id, 0.0, 0, '{answering.NO_EVIDENCE}' FROM embeddings WHERE vec_id % 50 = 0 AND vec_id NOT IN (SELECT query_id FROM ({_ranked("vec_id <> query_id AND s >= 0.08", 5)}))""")
def ideal_script_answers(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    found = index.search(rows, asked, 6, 0.08, id_col="vec_id").filter("vec_id <> query_id")
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(again)).filter("rank <= 5")
    got = harness.ideal_answers(asked.select(F.col("query_id").alias("task_id")), top)
    return got.withColumn("max_score", F.round("max_score", 6))


@query(f"SELECT task_id, run_id, array_to_string(list_sort(list_distinct(list_filter(cited, lambda x: x >= 1 AND x <= n))), ',') AS numbers FROM ({_METRICS})")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    got = _audits(spark, d).select("task_id", "run_id", answering.citation_numbers(F.col("answer"), F.size("evidence")).alias("x"))
    return got.select("task_id", "run_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("numbers"))


# ---- conversations and tool arguments

_TURNS = r"""SELECT conv_id, turn, trim(text) AS user, trim(next_text) AS assistant FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant' AND trim(text) <> '' AND trim(next_text) <> ''"""


@query(f"SELECT conv_id, turn, \"user\", assistant FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM ({_TURNS})) WHERE back <= 2")
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    return agent.last_turns(agent.turns(read(spark, d, "conversations")), 2)


@query(f"SELECT conv_id, CAST(2 * count(*) AS BIGINT) AS messages, sha256(string_agg('user:' || \"user\" || '|assistant:' || assistant, '|' ORDER BY turn)) AS digest FROM ({_TURNS}) GROUP BY conv_id")
def history_messages(spark: SparkSession, d: str) -> DataFrame:
    found = agent.history_messages(agent.turns(read(spark, d, "conversations")))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return found.select("conv_id", F.size("messages").cast("long").alias("messages"), F.sha2(said, 256).alias("digest"))


_ARGS = """CASE doc_id % 8 WHEN 0 THEN '{"query": "q"}' WHEN 1 THEN '{"query": "  "}' WHEN 2 THEN '{"query": "q", "top_k": 21}' WHEN 3 THEN '{"query": "q", "top_k": true}'
  WHEN 4 THEN '{"query": "q", "min_score": 1.5}' WHEN 5 THEN '{"query": "q", "extra": 1}' WHEN 6 THEN '[1]' ELSE '{broken' END"""


@query("SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'query' WHEN 2 THEN 'top_k' WHEN 3 THEN 'top_k' WHEN 4 THEN 'min_score' WHEN 5 THEN 'undeclared' WHEN 6 THEN 'not an object' WHEN 7 THEN 'not JSON' END AS problem FROM documents")
def tool_arg_validate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").selectExpr("doc_id", f"{_ARGS} AS a").select("doc_id", agent.check_arguments(F.col("a")).alias("problem"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'id' WHEN doc_id % 4 = 1 THEN 'no label' WHEN doc_id % 4 = 2 THEN 'no expected_points' END AS problem FROM documents")
def task_validate(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id") % 4
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    rows = read(spark, d, "documents").select("doc_id", F.when(r == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("id"), F.lit("q").alias("query"), F.lit("answerable").alias("task_type"), F.when(r == 1, none).otherwise(one).alias("relevant_chunk_ids"), none.alias("relevant_source_paths"), F.when(r == 2, none).otherwise(one).alias("expected_points"))
    return harness.check_tasks(rows).select("doc_id", "problem")


@query("SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS labels FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['b', 'a'] ELSE ['a', 'b'] END AS list_distinct_ordered FROM documents)")
def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, (" b", "a", "b ", "")))).otherwise(F.array(*map(F.lit, ("a", "a", " b "))))
    return read(spark, d, "documents").select("doc_id", F.array_join(text.ordered_distinct(given), ",").alias("labels"))


@query("SELECT source_path, CAST(row_number() OVER (ORDER BY lower(source_path), source_path) AS BIGINT) AS place FROM (SELECT '/docs/' || source || '/' || doc_id || '.txt' AS source_path FROM documents) ORDER BY place LIMIT 20")
def first_sources(spark: SparkSession, d: str) -> DataFrame:
    """A limited listing: the limit is the feature."""
    top = text_documents(spark, d).select("source_path").orderBy(F.lower("source_path"), "source_path").limit(20)
    return top.select("source_path", F.row_number().over(Window.orderBy(F.lower("source_path"), "source_path")).cast("long").alias("place"))
