"""License scans by diagonal voting.

Every rolling three-word gram of a text is hashed and joined to the grams of
license templates. A match at word i of the text and word j of a template votes
for the diagonal i - j. Votes are added up by text, template and diagonal;
neighbouring diagonals (words inserted or left out) are merged to a span. Spans
that hold enough votes are verified on the words themselves: a template's word is
held if the text has it where one of the span's diagonals says, and enough words
must be held, close enough together. Copies back to back merge to a span that is
too long; of such a span, each stretch that isn't, from any of its matches on, is
verified by itself.

Plain phrases ("mit license" and so on) are found beside it, at any place.

Only DataFrame functions are used. The templates are fixed and small, so they
are broadcast; texts are not shuffled, but for those with a span to verify.

Defined cases: null text is empty and has no words, places or labels; rows with
equal doc_id and text get equal results, votes being counted once for each
place; null doc_ids are kept; an empty table gives no rows; columns but doc_id
and text aren't looked at, whatever their names. A text's words are one array, so
a text may have 2 GB at most, as any value of Spark's.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filter_words, in_filter, materialise

GRAM = 3
#: Diagonals this close belong to one span.
NEAR = 3
#: Share of a template's words that a span must hold, and of its grams to be looked at.
#: Of one with fewer words than SHORT, where one word may tell licenses apart, all, on one diagonal.
SHARE, VOTES, SHORT = 0.75, 0.4, 16
#: A span may be this many times as long as its template.
STRETCH = 1.5

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The public wording of licenses and of the notices that they ask for.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_TERMS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL_TERMS = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ZLIB = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
_CC_SHORT = "Licensed under CC {} 4.0"
_CC_NAMES = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_NOTICES = {"mit": "Released under the MIT License", "apache": "Licensed under the Apache License, Version 2.0", "gpl": "Licensed under the GNU General Public License, version 3"}


def _plain(text: str) -> str:
    return " ".join(re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower()).split())


#: Texts by which licenses are known (label, words).
TEMPLATES = [
    (label, _plain(text))
    for label, text in [
        ("mit", _MIT),
        ("mit", _AS_IS_MIT),
        ("bsd", _BSD),
        ("bsd", _BSD_3),
        ("bsd", _AS_IS_BSD),
        ("apache", _APACHE),
        ("apache", _APACHE_TERMS),
        ("gpl", _GPL),
        ("gpl", _GPL_TERMS),
        ("mpl", _MPL),
        ("isc", _ISC),
        ("zlib", _ZLIB),
        ("unlicense", _UNLICENSE),
        *_NOTICES.items(),
        *((f"cc-{k}", _CC.format(v)) for k, v in _CC_NAMES.items()),
        *((f"cc-{k}", _CC_SHORT.format(k)) for k in _CC_NAMES),
    ]
]

_GRAMS = [[tuple(text.split()[j : j + GRAM]) for j in range(len(text.split()) - GRAM + 1)] for _, text in TEMPLATES]
#: So many places of a template have the same gram at most.
_PLACES = max(grams.count(g) for grams in _GRAMS for g in grams)


def template_grams(spark: SparkSession) -> DataFrame:
    """template, j, grams (of the template), gram_hash."""
    rows = []
    for i, (_, text) in enumerate(TEMPLATES):
        w = text.split()
        rows += [(i, j, len(w) - GRAM + 1, w[j], w[j + 1], w[j + 2]) for j in range(len(w) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "template int, j int, grams int, a string, b string, c string")
    return grams.select("template", "j", "grams", F.xxhash64("a", "b", "c").alias("gram_hash"))


def words_of(text: Column) -> Column:
    """Words. lower() does more than A-Z, but it moves no word's edge and makes no phrase."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _places(phrase: str, words: Column) -> Column:
    parts = phrase.split()
    hit = lambda w, i: reduce(lambda a, b: a & b, [w == parts[0], *(F.get(words, i + k) == p for k, p in enumerate(parts) if k)])
    marked = F.transform(words, lambda w, i: F.when(F.coalesce(hit(w, i), F.lit(False)), i))
    return F.array_compact(marked)


def candidates(docs: DataFrame) -> DataFrame:
    """Spans with enough votes: doc_id, text_hash, template, and for each stretch to
    verify its first and last gram (lo, hi) and its diagonals."""
    words = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    full = F.greatest(F.size("words") - (GRAM - 1), F.lit(0))  # the last grams are cut off
    rolled = words.select("doc_id", "text_hash", F.posexplode(F.slice(hashes, F.lit(1), full)).alias("i", "gram_hash"))
    votes = rolled.join(F.broadcast(template_grams(docs.sparkSession)), "gram_hash")
    by = ["doc_id", "text_hash", "template", "grams"]
    votes = votes.groupBy(*by, (F.col("i") - F.col("j")).alias("diagonal"), "i", "j").agg(F.lit(1).alias("one"))  # equal rows vote once
    diagonals = votes.groupBy(*by, "diagonal").agg(F.collect_set("j").alias("js"))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    merged = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(along))
    found = merged.withColumn("at", F.transform("js", lambda j: F.struct((j + F.col("diagonal")).alias("i"), j.alias("j"))))
    found = found.groupBy(*by, "span").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    most = F.floor(STRETCH * (F.col("grams") + GRAM - 1)).cast("int") - GRAM  # from the first to the last match
    held = lambda x: F.struct(x[0]["i"].alias("lo"), F.element_at(x, -1)["i"].alias("hi"), F.size(F.array_distinct(x["j"])).alias("held"), F.array_distinct(F.transform(x, lambda y: y["i"] - y["j"])).alias("diagonals"))
    stretches = F.transform("at", lambda x, k: held(F.filter(F.slice("at", k + 1, (most + 1) * _PLACES), lambda y: y["i"] - x["i"] <= most)))
    whole = F.element_at("at", -1)["i"] - F.col("at")[0]["i"] <= most
    found = found.select(*by, F.when(whole, F.array(held(F.col("at")))).otherwise(stretches).alias("parts"))
    found = found.select("doc_id", "text_hash", "template", F.filter("parts", lambda x: x["held"] >= VOTES * F.col("grams")).alias("parts"))
    return found.filter(F.size("parts") > 0)


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, first_word, last_word, score
    (the share of the template's words that the span holds). Those of copies
    back to back may overlap."""
    # One row for each text, so that its words are there once.
    part = F.transform("parts", lambda x: F.struct("template", x["lo"].alias("lo"), x["hi"].alias("hi"), x["diagonals"].alias("diagonals")))
    found = materialise(candidates(docs).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list(part)).alias("parts")))
    h = F.xxhash64("doc_id", "text_hash")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = in_filter(texts, filter_words(found.select(h.alias("h"))), h, "near").filter("near")
    texts = texts.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), words_of(F.col("text")).alias("words"))
    met = found.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    wanted = F.array(*(F.array(*map(F.lit, text.split())) for _, text in TEMPLATES))
    labels = F.array(*(F.lit(label) for label, _ in TEMPLATES))

    def share(x: Column) -> Column:
        at = lambda i: F.when(i >= 0, F.get("words", i))
        words = F.get(wanted, x["template"])
        held = lambda on: F.size(F.filter(F.transform(words, lambda w, j: F.exists(on, lambda d: F.coalesce(at(j + d) == w, F.lit(False)))), lambda y: y))
        one = F.array_max(F.transform(x["diagonals"], lambda d: held(F.array(d))))
        return F.when(F.size(words) < SHORT, one).otherwise(held(x["diagonals"])) / F.size(words)

    verified = F.transform("parts", lambda x: F.struct(F.get(labels, x["template"]).alias("label"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.size(F.get(wanted, x["template"])).alias("n"), share(x).alias("score")))
    enough = F.filter(verified, lambda x: x["score"] >= F.when(x["n"] < SHORT, 1.0).otherwise(SHARE))
    each = met.select("doc_id", "text_hash", F.explode(enough).alias("x"))
    return each.select("doc_id", "text_hash", "x.label", F.col("x.lo").alias("first_word"), (F.col("x.hi") + GRAM - 1).alias("last_word"), "x.score")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (of the best verified span; 1 with a phrase)."""
    words = words_of(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").contains("license").alias("maybe"), words.alias("words"))
    none = F.array().cast("array<int>")
    places = {f"at_{label}": F.when(F.col("maybe"), _places(p, F.col("words"))).otherwise(none) for p, label in PHRASES.items()}
    found = found.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), *(c.alias(n) for n, c in places.items()))
    at = F.concat(*places)
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES.values())))
    found = found.select("doc_id", "text_hash", "n_words", at.alias("at"), base.alias("base"))
    best = spans(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash")).agg(F.collect_set("label").alias("own"), F.max("score").alias("best"))
    met = found.join(best, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return met.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, with word strings in place of hashes; but merged
    spans that are too long, as of copies back to back, are left out whole."""
    grams = ", ".join(f"({i}, '{label}', {j}, {len(w) - GRAM + 1}, '{' '.join(w[j : j + GRAM])}')" for i, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for j in range(len(w) - GRAM + 1))
    wanted = ", ".join(f"({i}, '{label}', {j}, {len(w)}, '{x}')" for i, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for j, x in enumerate(w))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return f"""
WITH grams(template, label, j, n, gram) AS (VALUES {grams}),
wanted(template, label, j, n, word) AS (VALUES {wanted}),
phrases(phrase, label, n) AS (VALUES {phrases}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS i FROM w),
next AS (SELECT doc_id, i, x, lead(x, 1) OVER (PARTITION BY doc_id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM each),
base AS (
  SELECT doc_id, i, label FROM next JOIN phrases ON phrase = CASE WHEN n = 2 THEN x || ' ' || y ELSE x || ' ' || y || ' ' || z END),
bases AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM base GROUP BY doc_id),
votes AS (
  SELECT doc_id, template, label, n, i - j AS diagonal, i, j FROM next JOIN grams ON gram = x || ' ' || y || ' ' || z),
edge AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS r FROM votes),
steps AS (
  SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS fresh
  FROM (SELECT DISTINCT doc_id, template, diagonal FROM votes)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM steps),
found AS (
  SELECT v.doc_id, v.template, s.span FROM votes v
  JOIN numbered s ON v.doc_id = s.doc_id AND v.template = s.template AND v.diagonal = s.diagonal
  GROUP BY v.doc_id, v.template, v.n, s.span
  HAVING count(DISTINCT v.j) >= {VOTES} * v.n AND max(v.i) - min(v.i) + {GRAM} <= {STRETCH} * (v.n + {GRAM - 1})),
held AS (
  SELECT f.doc_id, t.label, t.n, count(DISTINCT t.j) / t.n AS share FROM found f
  JOIN numbered s ON f.doc_id = s.doc_id AND f.template = s.template AND f.span = s.span
  JOIN wanted t ON t.template = f.template
  JOIN each e ON e.doc_id = f.doc_id AND e.i = t.j + s.diagonal AND e.x = t.word
  GROUP BY f.doc_id, f.template, f.span, t.label, t.n, CASE WHEN t.n < {SHORT} THEN s.diagonal END),
verified AS (
  SELECT doc_id, list(DISTINCT label) AS own, max(share) AS best FROM held
  WHERE share >= CASE WHEN n < {SHORT} THEN 1 ELSE {SHARE} END GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(best, 0.0), 1.0) END::DOUBLE AS score
FROM w LEFT JOIN bases b ON w.doc_id = b.doc_id LEFT JOIN verified v ON w.doc_id = v.doc_id
"""
