"""Phrases that stand together more often than their words would.

Texts are cut into pieces and words; per shard (so many words of a task) the words get
ids, a suffix array over the ids is built by prefix doubling, and intervals of its
longest common prefixes give the counts of all phrases of a length. Counts of shards
are merged by (lang, phrase). Phrases of one and two words are counted first; longer
ones are looked for only where all their pairs of words may be frequent, as each phrase
that is frequent enough has only such pairs. Which pairs are is told by a filter of
fixed size, whose errors cost work, not results.

Defined cases: null and empty texts have no words; a null lang is ``und`` and shares its
counts; a text of any length is whole, as shards are cut anywhere and take up the last
words of the one before; rows that are repeated count each time; equal scores rank by
count, then phrase; an empty table gives no rows; columns besides lang and text are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, join_hot, materialise, tidy

#: Words of a shard, for which one suffix array is built.
SHARD_WORDS = 1 << 20
#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Bits of the filter of frequent pairs, and of each part that it is gathered in.
FILTER_BITS = 1 << 25
PART_BITS = 1 << 19
#: Ranks are taken in so many parts of a language first.
RANK_PARTS = 64

_BREAK = b"\xff"  # stands in no UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)
_GAP = re.compile(rb"[ \xff]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text, some at once: words with gaps of spaces, and a break for each end of a piece."""
    raw = raw.translate(_TABLE)
    at = 0
    while at < len(raw):
        end = _GAP.search(raw, at + SLICE_BYTES)
        to = end.end() if end else len(raw)
        yield raw[at:to].replace(_BREAK, b" \xff ")
        at = to
    yield _BREAK


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``ids`` ordered by the ``depth`` ids (or more) that follow, by prefix
    doubling, and how many ids (up to ``depth``) each has in common with the one before.
    A 0 is like nothing else, not even another 0."""
    n = len(ids)
    rank, known, order = ids.astype(np.int64), 1, None
    while order is None or known < depth:
        after = np.zeros(n, np.int64)
        if order is not None or depth > 1:
            after[: max(0, n - known)] = rank[known:]
            known *= 2
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            break
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    common, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for j in range(depth):
        a, b = padded[order[:-1] + j], padded[order[1:] + j]
        same &= (a == b) & (a != 0)
        common[1:] += same
    return order, common


class _Shard:
    """The words of some texts by language; ``before``: what the first text's words follow."""

    def __init__(self, lang: str | None = None, before: list[bytes] = ()):
        self.carried = len(before)
        self.size = 0
        self._slices: dict[str, list[bytes]] = {}
        self._flat: dict[str, list[pa.Array]] = {}
        self._held = 0
        if before:
            self.add(lang, b" ".join(before))

    def add(self, lang: str, words: bytes) -> None:
        self._slices.setdefault(lang, []).append(words)
        self._held += len(words)
        self.size += words.count(b" ") + 1
        if self._held >= SLICE_BYTES:
            self._split()

    def _split(self) -> None:
        for lang, some in self._slices.items():
            self._flat.setdefault(lang, []).append(pc.split_pattern(pa.array([b" ".join(some)], pa.binary()), b" ").flatten())
        self._slices, self._held = {}, 0

    def words(self) -> tuple[np.ndarray, pa.Array, np.ndarray, list[str]]:
        """Ids of the words in order, language by language; the words by id, each one's
        place among the languages, the languages. Breaks are 0."""
        self._split()
        ids, words, place, at = [np.zeros(0, np.int32)], [pa.array([b""], pa.binary())], [np.zeros(1, np.int32)], 1
        for k, flat in enumerate(self._flat.values()):
            known = pa.concat_arrays(flat).dictionary_encode()
            own = known.indices.to_numpy()
            empty, ends = (known.dictionary.index(pa.scalar(x, pa.binary())).as_py() for x in (b"", _BREAK))
            own = own[own != empty]
            ids.append(np.where(own == ends, 0, own + at).astype(np.int32))
            word = known.dictionary
            if ends >= 0:  # breaks have an id of their own, which isn't used, and are no UTF-8
                word = pa.concat_arrays([word[:ends], pa.array([b""], pa.binary()), word[ends + 1 :]])
            words.append(word)
            place.append(np.full(len(word), k, np.int32))
            at += len(word)
        return np.concatenate(ids), pa.concat_arrays(words).cast(pa.string()), np.concatenate(place), list(self._flat)


def _hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    seeds = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(words, langs, strict=True)), np.uint64, len(words))


def _bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of a pair of words, by their hashes, the bit of the filter."""
    h = (first * _MIX) ^ second
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(FILTER_BITS)).astype(np.int64)


def _frequent_stretches(ids: np.ndarray, words: pa.Array, place: np.ndarray, langs: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` cut down to stretches in which each pair of neighbours is in the filter, and where they stood."""
    h = _hashes(words.cast(pa.binary()).to_pylist(), [langs[k] for k in place])
    pair = np.zeros(len(ids), bool)
    both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    bit = _bits(h[ids[both]], h[ids[both + 1]])
    pair[both] = held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
    keep = pair.copy()
    keep[1:] |= pair[:-1]
    at = np.flatnonzero(keep)
    ends = ~pair[at]
    size = 1 + ends
    cut = np.repeat(ids[at], size)
    cut[np.cumsum(size)[ends] - 1] = 0
    return cut, np.repeat(at, size)


def _phrases(shard: _Shard, least: int, most: int, held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the shard's phrases of ``least`` to ``most`` words, and (of no word) of all words."""
    if not shard.size:
        return
    ids, words, place, langs = shard.words()
    at = np.arange(len(ids))
    if held is not None:
        ids, at = _frequent_stretches(ids, words, place, langs, held)
    if not len(ids):
        return
    names = pa.array(langs, pa.string())
    order, common = suffix_array(ids, most)
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    whole = np.ones(len(ids), bool)
    for d in range(1, most + 1):
        whole &= padded[d - 1 : d - 1 + len(ids)] != 0
        if d < least:
            continue
        mine = (whole & (at + d > shard.carried))[order]
        interval = (np.cumsum(common < d) - 1)[mine]
        where = order[mine]
        n = np.bincount(interval)
        begin = np.zeros(len(n), np.int64)
        begin[interval] = where
        begin, n = begin[n > 0], n[n > 0]
        if d == 1:
            total = np.bincount(place[ids[where]], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([names, pa.array([""] * len(langs), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "f"])
        for k in range(0, len(n), 1 << 16):
            some = begin[k : k + (1 << 16)]
            parts = [words.take(pa.array(padded[some + j])) for j in range(d)]
            phrase = pc.binary_join_element_wise(*parts, " ") if d > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(place[ids[some]])), phrase, pa.array(n[k : k + (1 << 16)], pa.int64())], ["lang", "phrase", "f"])


def count_phrases(docs: DataFrame, least: int, most: int, held=None) -> DataFrame:
    """Counts (lang, phrase, f) of all phrases of ``least`` to ``most`` words, per lang; with
    ``least`` 1 the empty phrase has the number of all words. ``held``: a broadcast filter;
    phrases with a pair of words that isn't in it may be left out."""

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8) if held is not None else None
        shard, over = _Shard(), most - 1
        for batch in batches:
            for lang, raw in zip(column(batch, "lang").to_pylist(), column(batch, "raw"), strict=True):
                tail = []
                for some in _slices(raw.as_py()):
                    shard.add(lang, some)
                    tail = [*tail, *some.rsplit(None, over)[-over:]][-over:] if over else []
                    if shard.size >= SHARD_WORDS + shard.carried:
                        yield from _phrases(shard, least, most, bits)
                        shard = _Shard(lang, tail)
        yield from _phrases(shard, least, most, bits)
        shard = None
        tidy()

    raw = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw")).filter("octet_length(raw) > 0")
    return raw.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def pair_filter(pairs: DataFrame):
    """A broadcast filter of FILTER_BITS bits over pairs (lang, phrase of two words)."""

    def bits(batches):
        for b in batches:
            both = [x.encode().split(b" ") for x in column(b, "phrase").to_pylist()]
            langs = column(b, "lang").to_pylist()
            if both:
                bit = _bits(_hashes([x[0] for x in both], langs), _hashes([x[1] for x in both], langs))
                yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])

    def part(table: pa.Table) -> pa.Table:
        k = table.column("part")[0].as_py()
        held = np.zeros(PART_BITS, np.uint8)
        held[table.column("bit").to_numpy() - k * PART_BITS] = 1
        return pa.table({"part": pa.array([k], pa.int64()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    found = pairs.select("lang", "phrase").mapInArrow(bits, "bit long").distinct()  # PART_BITS rows of a part at most
    parts = found.withColumn("part", F.expr(f"bit div {PART_BITS}")).groupBy("part").applyInArrow(part, "part long, held binary").collect()  # FILTER_BITS at most
    held = bytearray(FILTER_BITS // 8)
    for r in parts:
        held[r.part * PART_BITS // 8 : (r.part + 1) * PART_BITS // 8] = r.held
    return pairs.sparkSession.sparkContext.broadcast(bytes(held))


def frequent_phrases(docs: DataFrame, most: int, least_count: int, made: list[str] | None = None) -> DataFrame:
    """All phrases (lang, phrase, f) of up to ``most`` words that stand ``least_count`` times or
    more; the empty phrase has a language's number of words, whatever it is."""
    short = materialise(count_phrases(docs, 1, min(most, 2)).filter((F.col("f") >= least_count) | (F.col("phrase") == "")), made)
    if most < 3:
        return short
    held = pair_filter(short.filter(F.instr("phrase", " ") > 0))
    return short.unionByName(materialise(count_phrases(docs, 3, most, held).filter(F.col("f") >= least_count), made))


def _joined(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _key(phrase: str) -> Column:
    return F.concat(F.col(phrase), F.lit("\n"), F.col("lang"))  # no phrase holds a line's end


def collocations(docs: DataFrame, top: int = 2000, least_count: int = 10, most: int = 3, cover: int = 50, scale: int = 1_000_000) -> DataFrame:
    """Per lang the ``top`` phrases of 2 to ``most`` words by score: scale * a * a / (l * r), rounded
    down, of the cut that makes it least, where a, l and r count the phrase and its parts.
    Phrases that stand in a longer one for ``cover`` percent of their count or more are left out."""
    frequent = frequent_phrases(docs, most, least_count)
    words = F.split("phrase", " ")
    found = frequent.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))

    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), _joined(F.col("w"), 1, F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), _joined(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("part")))).alias("s"))
    rows = materialise(sides.select("lang", "phrase", "a", "k", "s.side", F.col("s.part").alias("part")).withColumn("key", _key("part")).drop("part"))
    info = rows.groupBy("key").agg(F.count("*").alias("many")).join(frequent.select(_key("phrase").alias("key"), "f"), "key")
    counted = join_hot(rows, materialise(info), "key", "many")
    by_cut = counted.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * {scale} div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = found.filter(F.size("w") > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("start"))
    longer = inner.groupBy("lang", _joined(F.col("w"), F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {cover} * a"))

    flat = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = flat.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("rank") <= top)
    n = frequent.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: All phrases counted one by one; the same score, cover and rank.
OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)),
grams AS (
  SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS left_part, array_to_string(w[c + 1 :], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS c FROM found)),
scored AS (
  SELECT c.lang, c.phrase, a, c, x.f AS l, y.f AS r,
    (1000000 * CAST(a AS HUGEINT) * CAST(a AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = left_part JOIN grams y ON y.lang = c.lang AND y.phrase = right_part),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM found WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least s LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
"""
