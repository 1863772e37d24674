"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph hashes to a wide vector of two parts. The first has 8 lanes of
64 bits, drawn uniformly from the paragraph (a digest of 512 bits), and decides
equality. The second has 128 lanes of 32 bits, to which each run of ten code
points of the paragraph adds +1 or -1 in one lane; inner products of such
vectors estimate how many runs two documents share. A document's vector is the
sum of its paragraphs', modulo 2**64 and 2**32 lane by lane. So it doesn't
depend on their order, and paragraphs are inserted or deleted by adding or
subtracting their vectors.

Defined cases: null text is empty; the empty text is one empty paragraph;
equal texts (and texts with the same paragraphs in another order) have equal
fingerprints; a table of one row is its own next document; rows with equal
doc_id follow one another by text; null doc_ids come last; an empty table gives no
rows; columns but doc_id and text aren't looked at, whatever their names. doc_id is an
integer of up to 64 bits (their ranges cut the order); another type is an error.
Texts are worked on whole, one block at a time, up to the 2 GB of a Spark value.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, strings, tidy

RUN = 10
WORDS, LANES = 8, 128
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's vector: uint64 of (n, 8), uint32 of (n, 128)."""
    exact = np.zeros((len(texts), WORDS), np.uint64)
    for i, t in enumerate(texts):
        digests = b"".join([hashlib.blake2b(p.encode("utf-8", "replace")).digest() for p in t.split("\n")])
        exact[i] = np.frombuffer(digests, "<u8").reshape(-1, WORDS).sum(0, dtype=np.uint64)
    # All code points in a row, with a line feed behind each text.
    cp = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(cp == 10)
    start = np.concatenate([[0], ends[:-1] + 1])
    size = ends - start
    doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    h1 = (cp.astype(np.uint64) + np.uint64(1)) * _MIX
    h = h1
    width = {1: h1}
    k = 1
    while 2 * k <= RUN:  # hashes of runs of 2, 4, 8 from those of half the length
        factor = np.uint64(pow(0xA0761D6478BD642F, k, 1 << 64) | 1)
        h = h[:-k] * factor + h[k:]
        h = h ^ (h >> np.uint64(29))
        k *= 2
        width[k] = h
    rest = RUN - k
    whole = width[k][: len(width[k]) - rest] * _ODD + width[rest][k : k + len(width[k]) - rest] if len(cp) >= RUN else np.zeros(0, np.uint64)
    n = np.maximum(size - RUN + 1, 0)
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    value, owner = whole[at], np.repeat(doc, n)
    short = np.flatnonzero((size < RUN) & (size > 0))  # a paragraph shorter than a run is one run
    if len(short):
        more = np.array([hash_short(cp[start[i] : ends[i]].tobytes()) for i in short], np.uint64)
        value, owner = np.concatenate([value, more]), np.concatenate([owner, doc[short]])
    value = (value ^ (value >> np.uint64(32))) * _MIX
    lane = (value >> np.uint64(57)).astype(np.int64)
    sign = 1.0 - 2.0 * ((value >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    sums = np.bincount(owner * LANES + lane, sign, len(texts) * LANES)
    return exact, sums.astype(np.int64).astype(np.uint32).reshape(-1, LANES)


def hash_short(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<u4").tobytes()).decode() for a, b in zip(exact, sketch, strict=True)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", WORDS), np.frombuffer(raw, "<u4", LANES, 8 * WORDS)


def insert(fingerprint: str, paragraph: str, sign: int = 1) -> str:
    """The fingerprint with a paragraph more (``sign`` -1: with one less)."""
    a, b = decode(fingerprint)
    x, y = vectors([paragraph])
    return encode((a + x if sign > 0 else a - x), (b + y if sign > 0 else b - y))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches, row by row: 1 for equal ones, about 0 for unrelated ones."""
    a, b = (x.view(np.int32).astype(np.float64) for x in (a, b))
    weight = (a * a).sum(1) + (b * b).sum(1)
    return np.where(weight > 0, np.clip(2 * (a * b).sum(1) / np.maximum(weight, 1), 0, 1), 1.0)


def with_next(docs: DataFrame, bytes_per_part: int = 16 << 20, most_parts: int = 10_000) -> DataFrame:
    """Partitions in which each row (doc_id, text, last = false) is followed by
    the next one in descending order of doc_id. The first row of a partition is
    also the last of the one before it (last = true), and the very first that of
    the last one. doc_ids alone decide the cuts; texts are shuffled once, and
    partitions are streamed, so their number may stay below ``most_parts``.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = int(min(most_parts, max(24, -(-(held.bytes or 0) // bytes_per_part))))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first().c
    cuts = np.array(sorted(set(cuts or [])), np.int64)
    n = len(cuts) + 2  # the last part is that of null doc_ids

    def part_of(ids: pa.Array) -> np.ndarray:
        at = len(cuts) - np.searchsorted(cuts, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), n - 1, at)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(part_of(ids), pa.int32())

    # One row per partition: its first doc_id.
    heads = {r.part: r.head for r in rows.select("doc_id", part("doc_id").alias("part")).groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # of the first: the last

    @F.arrow_udf("array<struct<part:int,last:boolean>>")
    def places(ids: pa.Array) -> pa.Array:
        out = []
        for p, i in zip(part_of(ids).tolist(), ids.to_pylist(), strict=True):
            out.append([{"part": p, "last": False}, {"part": before[p], "last": True}] if heads[p] == i else [{"part": p, "last": False}])
        return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("last", pa.bool_())])))

    sent = rows.select("doc_id", "text", F.explode(places("doc_id")).alias("to")).select("doc_id", "text", "to.part", "to.last")
    return sent.repartitionById(n, F.col("part")).sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of every text and of its edited text: the last third replaced by as many
    code points of the next document (descending doc_id)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def batch(ids: pa.Array, texts: list[str], n: int) -> pa.RecordBatch:
        """Of the first n texts; the one behind each is its next."""
        edited = [t[: len(t) - len(t) // 3] + nxt[: len(t) // 3] for t, nxt in zip(texts[:n], texts[1:], strict=False)]
        a, s = vectors(texts)
        b, e = vectors(edited)
        sha = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]
        cols = [ids.slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), pa.array(encode(a[:n], s[:n])), pa.array(encode(b, e)), pa.array(likeness(s[:n], e)), pa.array(likeness(s[:n], s[1:]))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, done = None, [], False
        for block in blocks(batches, most=4 << 20):
            if done:
                break
            last = column(block, "last").to_pylist()
            own = last.index(True) + 1 if True in last else len(last)  # more than one: equal doc_ids
            done = own < len(last) or last[-1]
            block = block.slice(0, own)
            got = column(block, "doc_id")
            ids = got if ids is None else pa.concat_arrays([ids, got])
            texts += strings(block)
            if len(texts) > 1:
                yield batch(ids, texts, len(texts) - 1)
            ids, texts = ids.slice(len(ids) - 1), texts[-1:]
        tidy()

    return with_next(docs).select("doc_id", "text", "last").mapInArrow(run, schema)
