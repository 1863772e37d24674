"""Near-duplicates by SetSketch registers.

A document's set is that of its five-word shingles (hashed to 64 bits). Its
sketch has 128 registers, each the minimum of one hash over the set, turned
into an exponential variate and truncated to a step of an exponential scale
(base 1.001, 16 bits). Sketches merge by taking the larger register. Four
registers make a band; documents that agree in one of 32 bands are candidates
(of a pair at the threshold, five in a million agree in none). The joint
likelihood of the registers above, below and equal gives an estimate of the
similarity; what is clearly below the threshold goes, and the rest is verified
on the full sets.

Groups are never paired with themselves. Equal sets are one node. In each
bucket, one pivot (the smallest node) is compared with all other nodes and what
is verified is linked; that connects most groups at about one comparison a node.
Buckets that still hold two components are finished in memory: a node outside
of the bucket's largest component meets those nodes of other components that share
a shingle among the rarest quarter of their sets (two sets with a similarity of
0.75 must). A bucket whose sets are too large for one task is cut into blocks, and
each block of such nodes meets each other block in a task of its own. So all pairs
of a bucket are compared or connected otherwise, and no link is lost.

Defined cases: null or empty text, or text without words, has an empty set and
is linked with nothing; a text of fewer than five words is one shingle; rows
with equal sets are linked; rows with null doc_id take part but give no id (a
component of such rows alone has a null id, and all of them are kept); rows that
share a doc_id with different texts are linked only if their sets are; an empty table
gives no rows; columns but doc_id and text aren't looked at, whatever their names.
A text is hashed whole by one task, so it may have 2 GB at most.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, blocks, claim, column, discard, join_hot, join_spread, map_blocks, materialise, release, strings, tidy
from .components import components

SHINGLE = 5
#: Similarity of a link: intersection / union >= PERCENT / 100.
PERCENT = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Of the exponential scale: base, rate, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Estimates below are five standard deviations below the threshold.
LEAST_ESTIMATE = 0.55
#: Bits of the filter that says which documents' sets to make again.
FILTER_BITS = 1 << 25
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 200_000
#: Bytes of sets that one task finishes in memory.
BUCKET_BYTES = 16 << 20
#: Bytes of text hashed at once.
BLOCK = 2 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.random.default_rng(20).integers(0, 1 << 63, REGISTERS + SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' shingle hashes in a row (with repeats), and how many each has."""
    import xxhash

    claim("near_dedup", _word_hashes.cache_clear)
    known = _word_hashes()
    if len(known) > REMEMBERED:  # memory stays bounded; they are also cleared when a task ends
        known.clear()
    listed = [t.encode("utf-8", "replace").translate(_LOWER).split() for t in texts]
    words = [w for x in listed for w in x]
    for w in set(words) - known.keys():
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = np.array([len(x) for x in listed], np.int64)
    start = np.cumsum(n) - n
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
    size = np.repeat(np.minimum(n, SHINGLE), many)
    out = size.astype(np.uint64) * _ODD[0]
    for k in range(SHINGLE):
        part = h[np.minimum(at + k, len(h) - 1)] if len(h) else h
        mixed = (out ^ (part * _ODD[REGISTERS + k])) * _ODD[1]
        out = np.where(k < size, mixed ^ (mixed >> np.uint64(31)), out)
    return out, many


def sketch(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Registers of each document that has shingles, one row each."""
    start = np.cumsum(many) - many
    start = start[many > 0]
    low = np.empty((len(start), REGISTERS), np.float64)
    for i in range(REGISTERS):
        y = hashes * _ODD[i]
        y ^= y >> np.uint64(32)
        low[:, i] = np.minimum.reduceat(y, start)
    variate = -np.log1p(-np.minimum((low + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity by maximum likelihood: registers of ``a`` are larger, smaller
    or equal with probabilities u - vJ, v - uJ and J, where u and v are the
    sets' shares of the sum of their sizes."""
    larger, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood's slope falls with J
        j = (lo + hi) / 2
        slope = equal / np.maximum(j, 1e-12) - larger * v / np.maximum(u - v * j, 1e-12) - smaller * u / np.maximum(v - u * j, 1e-12)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def _sets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    hashes, many = shingle_sets(texts)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(many)[:-1])] if len(texts) else [], hashes, many


def _node(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set, null if empty), bands."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        sets, hashes, many = _sets(strings(block))
        regs = np.zeros((len(sets), REGISTERS), np.uint16)
        if many.sum():
            regs[many > 0] = sketch(hashes, many)
        keys = regs.astype("<u2").view("<i8").reshape(-1)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
        return pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.binary()), bands], ["doc_id", "text_hash", "n_shingles", "node", "bands"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, node binary, bands array<long>"
    return map_blocks(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, schema, most=BLOCK, after=lambda: _word_hashes().clear())


def _filter_of(bits: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS from the numbers of its bits (column b): at most
    FILTER_BITS / 64 rows reach the driver, of any corpus."""
    words = np.zeros(FILTER_BITS // 64, np.int64)
    got = bits.groupBy(F.expr("cast(b div 64 AS INT)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(b, 64) AS INT))")).alias("x")).toArrow()
    words[got["w"].to_numpy()] = got["x"].to_numpy()
    return words.view(np.uint64)


def _in_filter(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return words[bits // 64] >> (bits % 64).astype(np.uint64) & np.uint64(1) == 1


def _buckets(b: pa.RecordBatch) -> np.ndarray:
    """Of each node and band, the bucket's number (64 bits)."""
    keys = pc.list_flatten(column(b, "bands")).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BANDS)
    mixed = (keys ^ _ODD[:BANDS]) * _ODD[BANDS : 2 * BANDS]
    return (mixed ^ (mixed >> np.uint64(29))) * _ODD[2 * BANDS]


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, n_shingles of buckets that more than one node may lie in. Of
    most bands only 64 bits are ever shuffled: a filter of fixed size over the
    buckets that recur tells which to spell out."""

    def numbers(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_buckets(b).reshape(-1).view(np.int64))], ["bucket"])

    again = nodes.select("bands").mapInArrow(numbers, "bucket long").groupBy("bucket").count().filter("count > 1")
    sent = nodes.sparkSession.sparkContext.broadcast(_filter_of(again.select(F.expr(f"pmod(bucket, {FILTER_BITS}L)").alias("b"))))

    def spelled(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = _buckets(b).view(np.int64)
            at, band = np.nonzero(_in_filter(sent.value, np.mod(found, FILTER_BITS)))
            yield pa.RecordBatch.from_arrays([pa.array(found[at, band]), *(column(b, c).take(pa.array(at)) for c in ("node", "n_shingles"))], ["bucket", "node", "n_shingles"])
        tidy()

    return nodes.select("node", "n_shingles", "bands").mapInArrow(spelled, "bucket long, node binary, n_shingles long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its whole set (sorted, 8 bytes each) of the ``wanted`` nodes.

    Texts aren't shuffled: a filter of fixed size over the ids of one document
    of each node tells which texts to hash again.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(bit(F.col("rep")).alias("b"))))

    def run(batches):
        for block in blocks(batches, most=BLOCK):
            hit = _in_filter(sent.value, column(block, "bit").to_numpy(zero_copy_only=False))
            if hit.any():
                sets, _, _ = _sets(strings(block.filter(pa.array(hit))))
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_pydict({"node": pa.array([_node(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
        _word_hashes().clear()
        tidy()

    made = docs.select("text", bit(F.col("doc_id")).alias("bit")).mapInArrow(run, "node binary, shingles binary")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose registers don't rule out a link."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bands").alias(f"b_{k}"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = [pc.list_flatten(column(b, c)).to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(-1, REGISTERS) for c in ("b_u", "b_v")]
            sizes = [column(b, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_u", "n_v")]
            ok = estimate(*regs, *sizes) >= LEAST_ESTIMATE
            yield b.filter(pa.array(ok)).select(["u", "v"])

    full = join_spread(join_spread(pairs, side("u"), "u", "v"), side("v"), "v", "u")
    return full.select("u", "v", "n_u", "n_v", "b_u", "b_v").mapInArrow(run, "u binary, v binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ok = []
            for x, y in zip(column(b, "s_u").to_pylist(), column(b, "s_v").to_pylist(), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(100 * common >= PERCENT * ((len(x) + len(y)) // 8 - common))
            yield b.filter(pa.array(ok)).select(["u", "v"])
        tidy()

    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s_{k}"))
    both = join_spread(join_spread(pairs, side("v"), "v", "u"), side("u"), "u", "v")
    return both.select("u", "v", "s_u", "s_v").mapInArrow(run, "u binary, v binary")


#: What a node does in a group: it asks (is compared with those that answer), answers, or both.
ASKS, ANSWERS = 1, 2


def linked(nodes: list[bytes], comps: list[bytes], roles: list[int], raw: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Links between different components: of each node that asks, with nodes that answer.

    Shingles are ordered by how many of the group's sets have them. Two sets with a
    similarity of 0.75 share one of the first quarter of each in that order.
    """
    held = [np.frombuffer(x, np.uint64) for x in raw]
    size = np.array([len(x) for x in held], np.int64)
    end = np.cumsum(size)
    _, ids, many = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(len(many))
    ids = rank[ids]
    many = np.sort(many)
    owner = np.repeat(np.arange(len(size)), size)
    ids = ids[np.lexsort((ids, owner))]
    place = np.arange(len(ids)) - np.repeat(end - size, size)
    first = (place < np.repeat(size - -(-PERCENT * size // 100) + 1, size)) & (many[ids] > 1)
    token, who = ids[first], owner[first]
    begin = np.searchsorted(who, np.arange(len(size) + 1))  # of each node's tokens
    role = np.array(roles)
    answering = np.flatnonzero(role[who] & ANSWERS)
    answering = answering[np.argsort(token[answering], kind="stable")]
    names, comp = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)
    mask = np.zeros(len(many), bool)
    out = []
    lo, hi = (np.searchsorted(token[answering], token, side) for side in ("left", "right"))
    for i in np.flatnonzero(role & ASKS):
        spans = [answering[lo[k] : hi[k]] for k in range(begin[i], begin[i + 1]) if hi[k] > lo[k]]
        if not spans:
            continue
        near = np.unique(who[np.concatenate(spans)])
        near = near[(comp[near] != comp[i]) & (100 * np.minimum(size[near], size[i]) >= PERCENT * np.maximum(size[near], size[i]))]
        if not len(near):
            continue
        own = ids[end[i] - size[i] : end[i]]
        mask[own] = True
        for some in np.array_split(near, -(-int(size[near].sum()) // 2_000_000)):
            sizes = size[some]
            starts = np.cumsum(sizes) - sizes
            common = np.add.reduceat(mask[ids[np.arange(sizes.sum()) + np.repeat(end[some] - sizes - starts, sizes)]], starts, dtype=np.int64)
            for j in some[100 * common >= PERCENT * (size[i] + sizes - common)]:
                if comp[j] != comp[i]:
                    out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                    comp[comp == comp[j]] = comp[i]
        mask[own] = False
    return out


def _grouped(members: DataFrame) -> DataFrame:
    """bucket, part, role, node, comp: the groups that one task each finishes, of the
    buckets (bucket, node, n_shingles, comp) that hold more than one component."""
    size = F.sum(F.col("n_shingles") * 8)
    shares = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"), size.alias("bytes"))
    largest = F.max(F.struct("bytes", "comp"))
    whole = shares.groupBy("bucket").agg(F.sum("n").alias("held"), F.sum("bytes").alias("bytes"), largest.alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    half = BUCKET_BYTES // 2 or 1
    parts = lambda c: F.ceil(c / half).cast("long")
    small = F.col("bytes") <= BUCKET_BYTES
    whole = whole.select(
        "bucket",
        "held",
        F.col("top.comp").alias("top"),
        F.when(small, 0).otherwise(parts(F.col("bytes") - F.col("top.bytes"))).alias("open"),
        F.when(small, 0).otherwise(parts(F.col("top.bytes"))).alias("closed"),
    )
    rows = join_hot(members, materialise(whole), "bucket", "held")
    outside = F.col("comp") != F.col("top")
    draw = F.xxhash64("node")
    group = lambda a, b, role: F.struct((a * (F.col("open") + F.col("closed")) + b).alias("part"), F.lit(role).alias("role"))
    steps = lambda lo, hi, f: F.when(hi >= lo, F.transform(F.sequence(lo, hi), f)).otherwise(F.array().cast("array<struct<part:bigint,role:int>>"))
    zero, own = F.lit(0).cast("long"), F.pmod(draw, F.greatest("open", F.lit(1)))
    asks = steps(own + 1, F.col("open") + F.col("closed") - 1, lambda b: group(own, b, ASKS))
    answers = steps(zero, own - 1, lambda a: group(a, own, ANSWERS))
    behind = F.col("open") + F.pmod(draw, F.greatest("closed", F.lit(1)))
    met = steps(zero, F.col("open") - 1, lambda a: group(a, behind, ANSWERS))
    one = F.array(F.struct(zero.alias("part"), F.when(outside, ASKS | ANSWERS).otherwise(ANSWERS).alias("role")))
    groups = F.when(F.col("open") == 0, one).when(outside, F.concat(F.array(group(own, own, ASKS | ANSWERS)), asks, answers)).otherwise(met)
    return rows.select("bucket", "node", "comp", F.explode(groups).alias("g")).select("bucket", "g.part", "g.role", "node", "comp")


def _finished(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between the components of each group, in memory, group by group."""

    def run(batches):
        at, held, out = None, ([], [], [], []), []
        for b in batches:
            for bucket, part, *row in zip(*(column(b, c).to_pylist() for c in ("bucket", "part", "node", "comp", "role", "shingles")), strict=True):
                if at != (bucket, part):
                    if len(held[0]) > 1:
                        out += linked(*held)
                    at, held = (bucket, part), ([], [], [], [])
                for x, y in zip(held, row, strict=True):
                    x.append(y)
            if len(out) > 5000:
                yield _pairs(out)
                out = []
        if len(held[0]) > 1:
            out += linked(*held)
        if out:
            yield _pairs(out)
        tidy()

    full = join_spread(groups, sets, "node", "bucket", "part").select("bucket", "part", "role", "node", "comp", "shingles")
    return full.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, "u binary, v binary").distinct()


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["u", "v"])


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (node) with comp, which is the node itself if it has no links."""
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_hash, n_shingles,
    component_id (smallest doc_id that links lead to), kept."""
    spark = docs.sparkSession
    kept: list[str] = []
    signed = materialise(signatures(docs), kept)
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, kept)
    members = materialise(shared_buckets(nodes), kept)
    # One pivot a bucket: nodes are digests, so the smallest is as good as any.
    buckets = materialise(members.groupBy("bucket").agg(F.count("*").alias("held"), F.min(F.struct("node", "n_shingles")).alias("pivot")).filter("held > 1"), kept)
    met = join_hot(members, buckets, "bucket", "held").filter(F.col("node") != F.col("pivot.node"))
    # Sizes alone rule out a pair whose smaller set can't cover enough of the larger.
    met = met.filter(100 * F.least("n_shingles", "pivot.n_shingles") >= PERCENT * F.greatest("n_shingles", "pivot.n_shingles"))
    pairs = materialise(met.select(F.col("node").alias("u"), F.col("pivot.node").alias("v")).distinct(), kept)
    release(spark)
    labels = None
    if not buckets.isEmpty():
        widest = nodes.agg(F.max("n_shingles")).first()[0]
        wanted = join_hot(members, buckets.select("bucket", "held"), "bucket", "held").select("node").distinct().join(nodes.select("node", "rep"), "node")
        sets = materialise(full_sets(docs, materialise(wanted, kept)), kept)
        likely = materialise(_estimated(pairs, nodes), kept)
        with batch_rows(spark, 16 * widest):
            links = materialise(_verified(likely, sets), kept)
        labels = materialise(components(links), kept)
        groups = materialise(_grouped(_named(members, labels)), kept)
        if not groups.isEmpty():
            with batch_rows(spark, 8 * widest):
                found = materialise(_finished(groups, sets), kept)
            labels = materialise(_joined(labels, found), kept)
    if labels is None:
        ids = nodes.select("node", "copies", F.col("rep").alias("component_id"))
    else:
        named = materialise(_named(nodes.select("node", "rep", "copies"), labels), kept)
        first = materialise(named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("held")), kept)
        ids = join_hot(named, first, "comp", "held").select("node", "copies", "component_id")
    ids = materialise(ids)
    some = join_hot(signed.filter(F.col("node").isNotNull()), ids, "node", "copies").select("doc_id", "text_hash", "n_shingles", "component_id")
    none = signed.filter(F.col("node").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.union(none)
    discard(spark, *(p for p in kept[1:]))
    release(spark)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, comp) after more links between nodes."""
    name = lambda k: labels.select(F.col("node").alias(k), F.col("comp").alias(f"c_{k}"))
    named = links.join(name("u"), "u", "left").join(name("v"), "v", "left")
    between = named.select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v")).filter("u != v")
    fresh = materialise(components(between)).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    sized = labels.groupBy("comp").agg(F.count("*").alias("size"))
    renamed = materialise(sized.join(fresh, "comp", "left").select("comp", "size", F.coalesce("new", "comp").alias("new")))
    moved = join_hot(labels, renamed, "comp", "size").select("node", F.col("new").alias("comp"))
    alone = fresh.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti")
    return moved.union(alone.select(F.col("comp").alias("node"), F.col("new").alias("comp")))
