"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fingerprint, html, langid, license_scan, line_dedup, near_dedup, oracles, packing, sharding, suffix_dedup, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("record.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), *langid.learn(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op7_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("record.doc_id", "n_lines", "n_deleted", "n_runs", "n_maximal", "longest", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: Lines of a later copy go; a copy is later if the same run stands at a smaller (doc_id, line).
#: Matches grow line by line while what they begin with stands twice; a run is maximal if it isn't
#: the rest of that of the line before.
OP10_SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, line, l FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
    FROM documents WHERE text IS NOT NULL)),
pairs AS (
  SELECT *, regexp_matches(l || l2, '[^ \t\r\f\v]') AS solid FROM (
    SELECT doc_id, line, l, lead(l) OVER (PARTITION BY doc_id ORDER BY line) AS l2 FROM lines)
  WHERE l2 IS NOT NULL),
runs AS (
  SELECT doc_id, line, solid, l, l2, row_number() OVER (PARTITION BY l, l2 ORDER BY doc_id, line) AS k,
    count(*) OVER (PARTITION BY l, l2) AS n FROM pairs),
grow(k, doc_id, line, name) AS (
  SELECT 2, doc_id, line, md5(md5(l) || md5(l2)) FROM runs WHERE n > 1
  UNION ALL
  SELECT k, doc_id, line, name FROM (
    SELECT g.k + 1 AS k, g.doc_id, g.line, md5(g.name || md5(x.l)) AS name
    FROM grow g JOIN lines x ON x.doc_id = g.doc_id AND x.line = g.line + g.k)
  QUALIFY count(*) OVER (PARTITION BY name) > 1),
matches AS (SELECT doc_id, line, max(k) AS match FROM grow GROUP BY doc_id, line),
begins AS (
  SELECT m.*, lag(m.line) OVER w AS line0, lag(match) OVER w AS match0
  FROM matches m JOIN runs r ON m.doc_id = r.doc_id AND m.line = r.line AND r.solid
  WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.line)),
maximal AS (
  SELECT doc_id, count(*) FILTER (NOT coalesce(line0 = line - 1 AND match0 = match + 1, false)) AS n_maximal, max(match) AS longest
  FROM begins GROUP BY doc_id),
later AS (SELECT doc_id, line FROM runs WHERE k > 1 AND solid),
gone AS (SELECT doc_id, line FROM later UNION SELECT doc_id, line + 1 FROM later),
marked AS (
  SELECT x.doc_id, x.line, x.l, g.line IS NOT NULL AS gone
  FROM lines x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.line = g.line),
found AS (
  SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS before FROM marked),
counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (gone AND NOT before) AS n_runs,
    sha256(coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
  FROM found GROUP BY doc_id
  UNION ALL
  SELECT doc_id, 0, 0, 0, sha256('') FROM documents WHERE text IS NULL)
SELECT c.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, CAST(n_runs AS BIGINT) AS n_runs,
  CAST(coalesce(n_maximal, 0) AS BIGINT) AS n_maximal, CAST(coalesce(longest, 0) AS BIGINT) AS longest, kept_sha256
FROM counted c LEFT JOIN maximal m ON c.doc_id = m.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op5_fm_index_decontamination": oracles.OP5, "op6_setsketch_near_dedup": oracles.OP6, "op7_run_length_dedup": oracles.OP7, "op9_diagonal_voting": license_scan.oracle(), "op10_line_dedup": OP10_SQL, "op11_collocations": collocations.OP11_SQL, "op12_warc": warc.OP12_SQL}
