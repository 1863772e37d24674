"""Removal of byte strings that occur more than once, by a run-length index.

Every window of 200 bytes has an anchor: among its 64-byte grams, the first of
those with the least hash. Equal windows have equal anchors at equal places, so
windows are compared only where an anchor recurs. Neighbouring windows with one
anchor are a context: its bytes from the first window's start to the last
one's end.

1. Anchors are counted; a filter of fixed size remembers those that recur.
2. The contexts of such anchors are cut out. Equal ones are one entry of the index
   with a count; all windows of an entry that counts twice match whole.
3. Different contexts of one anchor are indexed together, block by block: from
   their suffix array comes the Burrows-Wheeler transform, of which only runs matter.
   At a run's first and last row, the match with the row before or behind is
   measured; streamed on through the text, a match loses one byte a step until
   the next run end sampled. Windows whose match has 200 bytes are repeated.
4. An anchor whose contexts don't fit into one block is split over tasks first.
   All its windows hold the anchor (the core); of what else a window holds, at least
   half lies behind the core or more than half before it. Windows of the first kind
   can only be equal if the core and that half behind it are, the others if the core
   and the half before it are: that is a context's new core, and its hash the new
   anchor. So each context is cut in two, no pair of equal windows is parted, and
   after eight cuts at most, the core is the window.

Repeated windows are then merged into spans for each document.

Defined cases: null text is empty; texts under 200 bytes lose nothing; rows
with equal text are each other's repeats, and get equal results; null doc_ids
are kept; an empty table gives no rows; columns but doc_id and text aren't looked
at, whatever their names. A text is read whole by one task, so it may have 2 GB at
most, as any value of Spark's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, join_spread, map_blocks, materialise, strings, tidy

WINDOW = 200
GRAM = 64
SPAN = WINDOW - GRAM + 1  # grams in a window
#: Windows whose anchors are found at once, so that a worker's arrays stay in
#: its cache; at most 23 bits may number them.
CHUNK = 1 << 16
#: Bits of the filter of recurring anchors.
FILTER_BITS = 1 << 26
#: Bytes of one index.
INDEX_BYTES = 256 << 10
#: An anchor with more bytes of different contexts is split over tasks.
ANCHOR_BYTES = 1 << 20

_rng = np.random.default_rng(64)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of one chunk: first window, how many windows, anchor hash and place.
    valid: of each window (start), whether it lies in one document."""
    n = len(valid)
    h = _BYTE[data]
    for k in range(6):  # hashes of 2, 4, ... 64 bytes
        w = 1 << k
        h = h[:-w] * _STEP[k] + h[w:]
        h ^= h >> np.uint64(31)
    h *= _STEP[6]
    low = (h >> np.uint64(23) << np.uint64(23)) | np.arange(len(h), dtype=np.uint64)
    w = 1
    while 2 * w <= SPAN:  # least of 2, 4, ... 128 neighbours
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[: n], low[SPAN - w : SPAN - w + n])
    at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
    start = np.flatnonzero(valid)
    if not len(start):
        return start, start, np.zeros(0, np.int64), start
    owner = at[start]
    fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
    return start[fresh], np.diff(np.append(fresh, len(start))), h[owner[fresh]].view(np.int64), owner[fresh] - start[fresh]


def contexts(raws: list[bytes]):
    """(document, start, windows, anchor, place of the anchor from start on) of all
    contexts, chunk by chunk."""
    data = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(size)
    if not len(data):
        return
    doc = np.repeat(np.arange(len(raws)), size)
    for lo in range(0, len(data) - WINDOW + 1, CHUNK):
        n = min(CHUNK, len(data) - WINDOW + 1 - lo)
        at = np.arange(lo, lo + n)
        start, many, anchor, core = anchors(data[lo : lo + n + WINDOW - 1], at + WINDOW <= ends[doc[lo : lo + n]])
        d = doc[start + lo]
        yield d, start + lo - (ends - size)[d], many, anchor, core


def _signed(x: int) -> int:
    return x if x < 1 << 63 else x - (1 << 64)


def _raws(block: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in strings(block)]


def recurring(docs: DataFrame) -> np.ndarray:
    """The filter's bits: at most FILTER_BITS / 64 numbers, of any corpus."""

    def run(batches):
        for block in blocks(batches):
            for _, _, _, anchor, _ in contexts(_raws(block)):
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
        tidy()

    again = docs.select("text").mapInArrow(run, "anchor long").groupBy("anchor").count().filter("count > 1")
    bits = again.select(F.expr(f"pmod(anchor, {FILTER_BITS}L)").alias("b")).groupBy(F.expr("cast(b div 64 AS INT)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(b, 64) AS INT))")).alias("x"))
    got = bits.toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[got["w"].to_numpy()] = got["x"].to_numpy()
    return words.view(np.uint64)


def candidates(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, text_hash, start, windows, anchor, core (its place), context (hash), body
    of the contexts whose anchors may recur."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    names = ["doc_id", "text_hash"]

    def run(batches):
        import xxhash

        for block in blocks(batches):
            raws = _raws(block)
            for d, start, many, anchor, core in contexts(raws):
                b = np.mod(anchor, FILTER_BITS)
                hit = np.flatnonzero(sent.value[b // 64] >> (b % 64).astype(np.uint64) & np.uint64(1))
                for some in np.array_split(hit, -(-len(hit) // 10_000) or 1):
                    if not len(some):
                        continue
                    body = [raws[i][s : s + m + WINDOW - 1] for i, s, m in zip(d[some].tolist(), start[some].tolist(), many[some].tolist(), strict=True)]
                    own = [_signed(xxhash.xxh3_64_intdigest(x)) for x in body]
                    yield pa.RecordBatch.from_arrays(
                        [*(column(block, c).take(pa.array(d[some])) for c in names), pa.array(start[some]), pa.array(many[some].astype(np.int32)), pa.array(anchor[some]), pa.array(core[some].astype(np.int32)), pa.array(own), pa.array(body, pa.binary())],
                        [*names, "start", "windows", "anchor", "core", "context", "body"],
                    )
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, start long, windows int, anchor long, core int, context long, body binary")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of bytes, by prefix doubling from 7 bytes on. A suffix's rank is where its
    group begins; a round sorts only the suffixes whose group isn't settled."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + padded[k : k + n]
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)  # that of the end is 0, and of suffixes from 1 on
    at = np.arange(n)  # places in `order` that aren't settled
    key = key[order]
    k = 7
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(fresh)
        rank[order[at]] = np.repeat(at[first], np.diff(np.append(first, len(at)))) + 1
        alone = fresh & np.append(fresh[1:], True)
        at = at[~alone]
        if not len(at):
            return order
        some = order[at]
        key = rank[some] * (n + 2) + rank[np.minimum(some + k, n)]
        again = np.argsort(key)
        order[at], key = some[again], key[again]
        k *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to ``most``."""
    padded = np.concatenate([text, np.zeros(most + 8, text.dtype)])
    found = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    step = 8
    while len(open_):
        at = found[open_]
        x = padded[(a[open_] + at)[:, None] + np.arange(step)] == padded[(b[open_] + at)[:, None] + np.arange(step)]
        run = np.where(x.all(1), step, x.argmin(1))
        found[open_] += run
        open_ = open_[(run == step) & (found[open_] < most)]
        step = min(64, step * 2)
    return np.minimum(found, most)


def self_matches(text: np.ndarray) -> np.ndarray:
    """For each place, how many bytes from there on (up to 200) occur elsewhere too."""
    n = len(text)
    order = suffix_array(text)
    bwt = text[order - 1].astype(np.int64)
    bwt[order == 0] = -1
    turn = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # rows that begin a run
    best = np.zeros(n, np.int64)
    # Long matches arise at run ends alone, and they may be as long as the text.
    for rows, other in ((turn, turn - 1), (turn - 1, turn)):
        at, near = order[rows], order[other]
        sampled = np.argsort(at)
        at, length = at[sampled], _common(text, at, near, n)[sampled] if n else at
        if not len(at):
            continue
        last = np.searchsorted(at, np.arange(n), "right") - 1
        streamed = np.where(last >= 0, length[last] - (np.arange(n) - at[last]), 0)
        best = np.maximum(best, streamed)
    return np.minimum(best, WINDOW)


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_KEY = pa.struct([("anchor", pa.int64()), ("context", pa.int64())])
_FOUND = "anchor long, context long, ranges array<struct<lo:int,hi:int>>"
_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _indexed(groups: DataFrame) -> DataFrame:
    """Repeated windows (ranges of their numbers) of contexts, whole anchors at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join([r[4] + b"\xff" for r in rows]), np.uint8)  # 0xff is in no UTF-8
        match = self_matches(text)
        out, at = [], 0
        for anchor, context, n, windows, body in rows:
            flags = match[at : at + windows] >= WINDOW if n == 1 else np.ones(windows, bool)
            at += len(body) + 1
            if flags.any():
                out.append((anchor, context, _ranges(flags)))
        return _found(out)

    def run(batches):
        rows: list[tuple] = []
        single: list[tuple] = []
        held = 0
        group: list[tuple] = []

        def close():
            nonlocal held
            if len(group) == 1:
                anchor, context, n, windows, _ = group[0]
                if n > 1:
                    single.append((anchor, context, [{"lo": 0, "hi": windows}]))
            else:
                rows.extend(group)
                held += sum(len(r[4]) for r in group)
            group.clear()

        for b in batches:
            for row in zip(*(column(b, c).to_pylist() for c in ("anchor", "context", "n", "windows", "body")), strict=True):
                if group and group[0][0] != row[0]:
                    close()
                    if held >= INDEX_BYTES:
                        yield solve(rows)
                        rows.clear()
                        held = 0
                    if len(single) >= 10_000:
                        yield _found(single)
                        single.clear()
                group.append(row)
        close()
        if rows:
            yield solve(rows)
        if single:
            yield _found(single)
        tidy()

    return groups.select("anchor", "context", "n", "windows", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _RANGES)], ["anchor", "context", "ranges"])


def halves(body: bytes, windows: int, lo: int, hi: int) -> list[tuple[int, int, int, int, bytes, bytes]]:
    """A context whose windows all hold the core body[lo:hi], cut in two: first window,
    windows, the new core's lo and hi from there on, its bytes (with a mark of the
    side), and the body."""
    free = WINDOW - (hi - lo)
    behind = -(-free // 2)
    cut = min(max(hi + behind - WINDOW, 0), windows)  # from this window on, half lies behind the core
    out = []
    for first, last, a, b, side in ((0, cut, lo - (free - behind + 1), hi, b"<"), (cut, windows, lo, hi + behind, b">")):
        if last > first:
            out.append((first, last - first, a - first, b - first, side + body[a:b], body[first : last + WINDOW - 1]))
    return out


def split(parts: DataFrame) -> DataFrame:
    """``parts`` (key, shift, anchor, n, windows, lo, hi, body) of anchors with too many
    contexts, cut in two: the same columns, and context."""

    def run(batches):
        import xxhash

        names = ["key", "shift", "anchor", "context", "n", "windows", "lo", "hi", "body"]
        kinds = [_KEY, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for key, shift, anchor, n, windows, lo, hi, body in zip(*(column(b, c).to_pylist() for c in ("key", "shift", "anchor", "n", "windows", "lo", "hi", "body")), strict=True):
                for first, many, x, y, core, own in halves(body, windows, lo, hi):
                    fresh = _signed(xxhash.xxh3_64_intdigest(core, anchor & (1 << 64) - 1))
                    for at, v in zip(rows, (key, shift + first, fresh, _signed(xxhash.xxh3_64_intdigest(own)), n, many, x, y, own), strict=True):
                        at.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names)
        tidy()

    schema = "key struct<anchor:long,context:long>, shift int, anchor long, context long, n long, windows int, lo int, hi int, body binary"
    return parts.select("key", "shift", "anchor", "n", "windows", "lo", "hi", "body").mapInArrow(run, schema)


def _with_size(parts: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Those of ``parts`` whose anchors fit into one block, and the others, or None."""
    each = parts.select("anchor", "context", F.octet_length("body").cast("long").alias("bytes")).distinct()
    wide = materialise(each.groupBy("anchor").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > ANCHOR_BYTES).select("anchor"), made)
    if wide.isEmpty():
        return parts, None
    return parts.join(wide, "anchor", "left_anti"), parts.join(wide, "anchor", "left_semi")


def _matched(groups: DataFrame, made: list[str]) -> DataFrame:
    """key (anchor, context) and ranges of repeated windows of all ``groups``."""
    near, wide = _with_size(groups, made)
    done = [_indexed(near).select(F.struct("anchor", "context").alias("key"), "ranges")]
    if wide is not None:
        start = F.col("core")
        wide = wide.select(F.struct("anchor", "context").alias("key"), F.lit(0).alias("shift"), "anchor", "n", "windows", start.alias("lo"), (start + GRAM).alias("hi"), "body")
    while wide is not None:
        parts = materialise(split(wide), made)
        near, wide = _with_size(parts, made)
        near = near.withColumn("part", F.struct("anchor", "context"))
        entries = near.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.first("windows").alias("windows"), F.first("body").alias("body"))
        entries = materialise(entries.select("part", "part.*", "n", "parts", "windows", "body"), made)
        found = materialise(_indexed(entries).select(F.struct("anchor", "context").alias("part"), "ranges").join(entries.select("part", "parts"), "part"), made)
        met = join_spread(near.select("key", "shift", "part"), found, "part", "key", weight="parts")
        done.append(met.select("key", F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("shift")).alias("lo"), (r["hi"] + F.col("shift")).alias("hi"))).alias("ranges")))
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return every


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (lo, hi of bytes; they may touch) of documents with repeats."""
    made: list[str] = []
    found = materialise(candidates(docs, recurring(docs)), made)
    groups = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("core").alias("core"), F.first("body").alias("body"))
    groups = materialise(groups, made)
    counts = groups.select(F.struct("anchor", "context").alias("key"), "n")
    hits = materialise(_matched(groups, made), made)
    hits = materialise(hits.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).join(counts, "key"), made)
    places = join_spread(found.select("doc_id", "text_hash", "start", F.struct("anchor", "context").alias("key")), hits, "key", "text_hash", "start", weight="n")
    spans = F.transform("ranges", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"] - 1 + WINDOW).alias("hi")))
    out = materialise(places.select("doc_id", "text_hash", spans.alias("spans")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    discard(docs.sparkSession, *made)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (merged), of
    every document (doc_id, text); the spans are of UTF-8 bytes."""
    spans = repeated_spans(docs).select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spans")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    met = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_hash") == F.col("span_hash")), "left")
    merged_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, found in zip(_raws(block), column(block, "spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((s["lo"], s["hi"]) for s in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            sha, at = hashlib.sha256(), 0
            for lo, hi in merged:
                sha.update(raw[at:lo])
                at = hi
            sha.update(raw[at:])
            out.append((len(raw), sum(hi - lo for lo, hi in merged), len(merged), sha.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged]))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([column(block, "doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4], merged_type)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_blocks(met.select("doc_id", "text", "spans"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")
