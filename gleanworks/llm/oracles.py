"""DuckDB SQL for the contracts that SQL can express."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Windows of ten words (or a shorter item whole) looked up in all documents.
OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS gram
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item, k, n FROM grams JOIN windows USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Exact similarities of all documents that share a shingle, and what links reach.
OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

#: Every window of 200 bytes by its hash; a byte goes if a repeated one covers it.
OP7 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, p, CASE WHEN 2 * p + 400 <= length(h) THEN hash(substr(h, 2 * p + 1, 400)) END AS g
  FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS p FROM d)),
again AS (SELECT g FROM g WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, p, CASE WHEN again.g IS NULL THEN 0 ELSE 1 END AS rep FROM g LEFT JOIN again ON g.g = again.g),
c AS MATERIALIZED (SELECT doc_id, p, max(rep) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM r),
runs AS (
  SELECT doc_id, gone, min(p) AS lo, count(*) AS n
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, gone ORDER BY p) AS run FROM c) GROUP BY doc_id, gone, run),
a AS (
  SELECT doc_id, sum(n) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1) AS n_spans,
    string_agg(substr(h, 2 * lo + 1, 2 * n), '' ORDER BY lo) FILTER (gone = 0) AS kept
  FROM runs JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
