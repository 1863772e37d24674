"""Queries over inputs that both engines build alike from the tables: pages with links
and lists in their body, a site to crawl, items of evidence, directories at two times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import answering, harness, incremental, web
from ..sources import html
from .catalog import _CHUNKING, query, read

# ---- pages: one for each row of `pages`, of its id, language and host

_PAGE = """'<html><head><title>Page ' || page_id || ' &amp; more</title></head><body><nav><a href="/menu">menu</a></nav><article><h1>Title ' || page_id || '</h1>'
  || '<p>See <a href="/p/' || (page_id * 2 + 1) || '#part">one</a>, <a href="HTTPS://Other' || (page_id % 7) || '.Example/q?x=' || page_id || '">two</a>, <a href="mailto:a@b.example">mail</a>'
  || ' and <a href="../up/' || (page_id % 3) || '">three</a>, <a href="/p/' || (page_id * 2 + 1) || '">one again</a>.</p>'
  || '<h2>Part ' || (page_id % 5) || '</h2><ul><li>first &lt;' || page_id || '</li><li>second <i>x</i></li></ul>'
  || '<table><tr><th>a</th><th>b</th></tr><tr><td>' || page_id || '</td><td>2</td></tr></table>'
  || '<script>no()</script></article><footer>foot</footer></body></html>'"""
_URL = "'https://site.example/a/' || page_id"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").selectExpr("page_id", f"{_URL} AS url", f"{_PAGE} AS html")


@query("""SELECT page_id, pos, link FROM (
  SELECT page_id, 0 AS pos, 'https://site.example/p/' || (page_id * 2 + 1) AS link FROM pages
  UNION ALL SELECT page_id, 1, 'https://other' || (page_id % 7) || '.example/q?x=' || page_id FROM pages
  UNION ALL SELECT page_id, 2, 'https://site.example/up/' || (page_id % 3) FROM pages)""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Absolute links in their order: no fragments, no repeats, no mail, no menus."""
    return _pages(spark, d).select("page_id", F.posexplode(html.links_udf(F.col("html"), F.col("url"))).alias("pos", "link"))


@query("""WITH blocks AS (
  SELECT page_id, 0 AS block_pos, 'See one , two , mail and three , one again .' AS text, '' AS part FROM pages
  UNION ALL SELECT page_id, 1, 'first <' || page_id, ' / Part ' || (page_id % 5) FROM pages
  UNION ALL SELECT page_id, 2, 'second x', ' / Part ' || (page_id % 5) FROM pages
  UNION ALL SELECT page_id, 3, 'a | b' || chr(10) || page_id || ' | 2', ' / Part ' || (page_id % 5) FROM pages)
SELECT page_id, block_pos, text, 'Page ' || page_id || ' & more / Title ' || page_id || part AS path,
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY block_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM blocks""")
def html_blocks_built(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, list items and tables of a page's body, with headings and offsets."""
    blocks = html.page_blocks(_pages(spark, d).select("page_id", "html"), "page_id").withColumnRenamed("page_id", "doc_id")
    found = web.block_offsets(blocks)
    return found.select(F.col("doc_id").alias("page_id"), "block_pos", "text", F.array_join("heading_path", " / ").alias("path"), F.col("normalized_char_start").cast("long").alias("char_start"))


# ---- a site: page i links to i, 2i + 1, a page that is missing, 2i + 2 and another host

_SITE = """'<html><body><article><h1>' || i || '</h1><p><a href="/s/' || i || '">self</a> <a href="/s/' || (2 * i + 1) || '">left</a> <a href="/gone/' || i || '">gone</a>'
  || ' <a href="/s/' || (2 * i + 2) || '#x">right</a> <a href="https://else.example/">else</a></p></article></body></html>'"""
_DEPTH, _MOST = 4, 20


def _numbered(ids: DataFrame) -> DataFrame:
    """Places (i, from 0) of pages by id: counts of ids below, from ranges of them."""
    ranked = ids.orderBy("page_id").withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    sizes = ranked.groupBy(part.alias("part")).count()
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.expr("b.part < a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    return ranked.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.expr("at - shiftleft(part, 33)")).alias("i"))


@query(f"""WITH RECURSIVE site AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages),
walk(url, i, depth, path) AS (
  SELECT 'https://site.example/s/0', 0, 0, [0] WHERE EXISTS (SELECT 1 FROM site)
  UNION ALL
  SELECT CASE WHEN k = 1 THEN 'https://site.example/gone/' || i ELSE 'https://site.example/s/' || (2 * i + 1 + k / 2) END, CASE WHEN k = 1 THEN -1 ELSE 2 * i + 1 + k / 2 END, depth + 1, list_append(path, k)
  FROM walk, (VALUES (0), (1), (2)) v(k) WHERE depth < {_DEPTH} AND i IN (SELECT i FROM site)),
ordered AS (
  SELECT url, depth, row_number() OVER (ORDER BY depth, path) AS pos, CASE WHEN i IN (SELECT i FROM site) THEN 'fetched' ELSE 'missing' END AS status FROM walk),
counted AS (
  SELECT *, coalesce(sum(CASE WHEN status = 'fetched' THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ordered)
SELECT url, depth, pos, status FROM counted WHERE before < {_MOST}""".replace("k / 2", "k // 2"))
def crawl_pages(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first from page 0, four links deep, until 20 pages are read."""
    numbered = _numbered(read(spark, d, "pages").select("page_id"))
    site = numbered.selectExpr("'https://site.example/s/' || i AS url", f"{_SITE} AS html")
    found = web.crawl(site, "https://site.example/s/0", web.CrawlConfig(max_pages=_MOST, max_depth=_DEPTH))
    return found.select("url", "depth", F.col("pos").cast("long").alias("pos"), "status")


# ---- evidence: five documents in a row are the results of one question

_ITEM = [
    "CAST(floor(doc_id / 5) AS BIGINT) AS query_id",
    "CAST(doc_id % 5 + 1 AS INT) AS rank",
    "'c' || doc_id AS chunk_id",
    "'/docs/' || source AS source_path",
    "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 + 1 AS INT) END AS page_start",
    "CAST(doc_id % 3 AS INT) AS depth",
    "text",
]


@query(rf"""WITH items AS (
  SELECT query_id, rank, '[' || rank || '] 来源：' || source_path || coalesce('，第 ' || page_start || ' 页', '') || CASE depth WHEN 0 THEN '' WHEN 1 THEN '，章节：H' ELSE '，章节：H / H' END
    || '（chunk_id=' || chunk_id || '）' || chr(10) AS head, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body
  FROM (SELECT {', '.join(_ITEM)} FROM documents WHERE text IS NOT NULL)),
placed AS (
  SELECT *, 2000 - coalesce(sum(length(head) + length(body) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM items),
cut AS (
  SELECT query_id, rank, head || CASE WHEN length(head) + length(body) <= room THEN body
    WHEN room - length(head) <= 1 THEN substr(body, 1, CAST(room - length(head) AS BIGINT)) ELSE regexp_replace(substr(body, 1, CAST(room - length(head) - 1 AS BIGINT)), '\s+$', '') || '…' END AS piece
  FROM placed WHERE length(head) + length(body) <= room OR room > length(head))
SELECT query_id, string_agg(piece, chr(10) || chr(10) ORDER BY rank) AS context FROM cut GROUP BY query_id""")
def evidence_built(spark: SparkSession, d: str) -> DataFrame:
    """Numbered items up to 2,000 characters; the first that doesn't fit is cut, or left out."""
    rows = read(spark, d, "documents").filter("text IS NOT NULL").selectExpr(*_ITEM)
    rows = rows.withColumn("heading_path", F.array_repeat(F.lit("H"), F.col("depth")))
    return answering.evidence_context(rows, 2000)


# ---- a directory at two times: documents as files named by their id; between, texts were
# edited (those that are longer than 1,000 and hold "a"), files of one source removed and
# files of one language are new

_THEN = "SELECT '/docs/' || doc_id || '.txt' AS source_path, sha256(text) AS h, length(text) AS n FROM documents WHERE text IS NOT NULL AND lang IS DISTINCT FROM 'fr'"
_NOW = "SELECT '/docs/' || doc_id || '.txt' AS source_path, sha256(CASE WHEN length(text) > 1000 THEN replace(text, 'a', 'A') ELSE text END) AS h FROM documents WHERE text IS NOT NULL AND (source IS NULL OR source NOT IN (SELECT min(source) FROM documents))"


def _two_times(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text IS NOT NULL").withColumn("source_path", F.concat(F.lit("/docs/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    gone = F.broadcast(docs.agg(F.min("source").alias("removed")))  # one row
    fingerprint = identity.ingestion_fingerprint("txt", "utf-8-sig")
    old = docs.filter(~F.col("lang").eqNullSafe(F.lit("fr"))).select("source_path", F.sha2("text", 256).alias("content_hash"), F.lit(fingerprint).alias("ingestion_fingerprint"), F.lit(_CHUNKING).alias("chunking_fingerprint"), F.lit(1).cast("long").alias("chunk_count"))
    edited = F.when(F.length("text") > 1000, F.replace("text", F.lit("a"), F.lit("A"))).otherwise(F.col("text"))
    now = docs.join(gone).filter("NOT source <=> removed").select("source_path", F.sha2(edited, 256).alias("content_hash"), F.lit(fingerprint).alias("ingestion_fingerprint"), F.lit(None).cast("string").alias("error"))
    return incremental.classify(now, old, old.select("source_path", F.col("chunk_count").alias("chunks")), "/docs", _CHUNKING)


@query(f"""SELECT coalesce(a.source_path, b.source_path) AS source_path,
  CASE WHEN b.source_path IS NULL THEN 'deleted' WHEN a.source_path IS NULL THEN 'added' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS status
  FROM ({_THEN}) a FULL JOIN ({_NOW}) b ON a.source_path = b.source_path""")
def incremental_texts(spark: SparkSession, d: str) -> DataFrame:
    """Which files were added, updated, deleted or stayed, by their texts' hashes."""
    return _two_times(spark, d).select("source_path", "status")


# ---- what a judge reads

_TASK = ["doc_id AS task_id", "substr(text, 1, 40) AS query", "CASE WHEN length(text) % 4 = 0 THEN 'refusal' ELSE 'answerable' END AS task_type"]


@query(f"""SELECT task_id, '## Question' || chr(10) || query || chr(10) || chr(10) || '## Points' || chr(10) || CASE WHEN task_type = 'refusal' THEN '-' ELSE 'p1; ' || source END
  || chr(10) || chr(10) || '## Evidence' || chr(10) || CASE WHEN task_type = 'refusal' THEN '（无证据）' ELSE '[1]（本地）' || source || ': ' || substr(text, 1, 240) || chr(10) || '[2]（网络）u: ' || source END
  || chr(10) || chr(10) || '## Answer' || chr(10) || 'It is so [1].' || CASE WHEN task_type = 'refusal' THEN chr(10) || chr(10) || '{harness.TRAP_NOTE}' ELSE '' END AS prompt
  FROM (SELECT {', '.join(_TASK)}, source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)""")
def judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Question, points, evidence and answer; a note where there is no answer."""
    rows = read(spark, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").selectExpr(*_TASK, "source", "text")
    answerable = F.col("task_type") != "refusal"
    item = lambda kind, path, text: F.struct(F.lit(kind).alias("source_type"), path.alias("source_path"), text.alias("text"))
    seen = F.array(item("local", F.col("source"), F.col("text")), item("web", F.lit("u"), F.col("source")))
    tasks = rows.select("task_id", "query", "task_type", F.when(answerable, F.array(F.lit("p1"), F.col("source"))).alias("expected_points"))
    audits = rows.select("task_id", F.lit(0).alias("run_id"), F.lit("It is so [1].").alias("answer"), F.when(answerable, seen).alias("evidence"))
    return harness.judge_prompts(tasks, audits).select("task_id", "prompt")
