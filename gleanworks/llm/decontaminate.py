"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents, as one row of word numbers (words outside the
benchmark end a run). Runs in which every two neighbouring words also stand
side by side in the benchmark are the only places where a window can occur;
they make up the indexed text. Its Burrows-Wheeler transform is kept in a
wavelet matrix; all windows are searched backward at once by its ranks, and
their occurrences are located by walking to sampled suffix positions. What the
occurrences cover is merged into spans. Documents aren't shuffled.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. A
window is ``width`` consecutive words of an item; a shorter item is one window.

Defined cases: null or empty text or items have no words; a null item_id counts
as the empty string; items with the same id are one item; repeated documents
each get the same row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_blocks, strings

WIDTH = 10
#: UTF-8 bytes of items that one pass over the documents searches for.
PASS_BYTES = 8 << 20
#: Words of one index.
INDEX_WORDS = 400_000
SAMPLED = 8

_WORD = bytes(c if c >= 128 or chr(c).isalnum() and c < 128 else 32 for c in range(256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _WORD[c] for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class FMIndex:
    """Of a row of numbers >= 0; 0 ends runs and is in no pattern.

    Inside, numbers are larger by one: 0 is the end of the text, and only that.
    """

    def __init__(self, text: np.ndarray):
        text = np.append(text + 1, 0)
        n = len(text)
        self.text_n = n
        order, rank = self._sorted_suffixes(text)
        bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.levels = max(1, int(text.max()).bit_length())
        self.ones, self.zeros, row = [], [], bwt
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix
            bit = row >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        self.sample = np.where(order % SAMPLED == 0, order, -1)

    @staticmethod
    def _sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By prefix doubling; the end is the smallest symbol and stands once,
        so it doesn't matter that suffixes wrap around."""
        n = len(text)
        rank = text.astype(np.int64)
        k = 1
        while True:
            key = rank * (n + int(rank.max()) + 2) + np.roll(rank, -k)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order, rank
            k *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        first = np.zeros_like(at)
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbol >> level & 1).astype(bool)
            at, first = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (at, first))
        return at - first

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each pattern (one per row of the
        array, filled up with -1 in front): first, and behind the last."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.text_n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j] + 1
            go = np.flatnonzero((c > 0) & (lo < hi))
            known = c[go] < len(self.before) - 1
            lo[go[~known]] = hi[go[~known]] = 0
            go = go[known]
            s = c[go]
            lo[go], hi[go] = self.before[s] + self.rank(s, lo[go]), self.before[s] + self.rank(s, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, from the sampled ones."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = self.sample[at]
        walk = np.flatnonzero(out < 0)
        while len(walk):
            c = self.bwt[at[walk]].astype(np.int64)
            at[walk] = self.before[c] + self.rank(c, at[walk])
            steps[walk] += 1
            out[walk] = self.sample[at[walk]]
            walk = walk[out[walk] < 0]
        return (out + steps) % self.text_n


@dataclass
class Windows:
    """The windows of some items."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # neighbouring words of items, as one number each; sorted
    patterns: np.ndarray  # distinct windows, filled up with -1 in front
    size: np.ndarray
    items: list[list[str]]  # of each window
    shortest: int


def windows(items: list[tuple[str, str]], width: int = WIDTH) -> Windows:
    vocabulary: dict[bytes, int] = {}
    pairs: set[tuple[int, int]] = set()
    found: dict[tuple[int, ...], set[str]] = {}
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        pairs.update(zip(ids, ids[1:], strict=False))
        for i in range(max(1, len(ids) - width + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + width]), set()).add(name)
    v = len(vocabulary) + 1
    patterns = np.full((len(found), width), -1, np.int64)
    for row, w in zip(patterns, found, strict=True):
        row[width - len(w) :] = w
    size = np.array([len(w) for w in found], np.int64)
    return Windows(vocabulary, np.array(sorted(a * v + b for a, b in pairs), np.int64), patterns, size, [sorted(x) for x in found.values()], int(size.min()) if len(size) else 0)


def occurrences(w: Windows, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each occurrence of a window in ``row`` (numbers of words, 0
    where none), and the window's number."""
    none = np.zeros(0, np.int64)
    if not len(w.size) or len(row) < w.shortest:
        return none, none
    key = row[:-1] * (len(w.vocabulary) + 1) + row[1:]
    maybe = np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
    joined = np.zeros(len(row), bool)  # this word and the next are a pair of the benchmark
    if len(w.pairs) and len(maybe):
        at = np.minimum(np.searchsorted(w.pairs, key[maybe]), len(w.pairs) - 1)
        joined[maybe] = w.pairs[at] == key[maybe]
    first = np.flatnonzero((row > 0) & ~np.concatenate([[False], joined[:-1]]))
    last = np.flatnonzero((row > 0) & ~joined)
    long = last - first + 1 >= w.shortest
    first, last = first[long], last[long]
    starts, which = [], []
    held = np.cumsum(last - first + 2)
    for cut in np.split(np.arange(len(first)), np.searchsorted(held, np.arange(INDEX_WORDS, held[-1], INDEX_WORDS))) if len(first) else []:
        if not len(cut):
            continue
        n = last[cut] - first[cut] + 2
        at = np.repeat(first[cut] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.where(at > np.repeat(last[cut], n), 0, row[np.minimum(at, len(row) - 1)])
        index = FMIndex(text)
        lo, hi = index.search(w.patterns)
        many = np.maximum(hi - lo, 0)
        rows = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        starts.append(at[index.locate(rows)])
        which.append(np.repeat(np.arange(len(many)), many))
    return (np.concatenate(starts), np.concatenate(which)) if starts else (none, none)


def _pass(docs: DataFrame, names: list[str], w: Windows) -> DataFrame:
    """One pass over ``docs``: fills n_words, and adds to spans and items."""
    sent = docs.sparkSession.sparkContext.broadcast(w)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_words long, spans array<struct<start:long,stop:long>>, items array<string>"

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        w = sent.value
        get = w.vocabulary.get
        listed = [words(t) for t in strings(block)]
        n = np.array([len(x) for x in listed], np.int64)
        base = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)  # a 0 behind each document
        row = np.zeros(base[-1], np.int64)
        for x, at in zip(listed, base, strict=False):
            row[at : at + len(x)] = [get(y, 0) for y in x]
        start, which = occurrences(w, row)
        doc = np.searchsorted(base, start, "right") - 1
        spans = [[(s["start"], s["stop"]) for s in x] for x in column(block, "spans").to_pylist()]
        items = [set(x) for x in column(block, "items").to_pylist()]
        order = np.argsort(start, kind="stable")
        for d, s, k in zip(doc[order].tolist(), (start - base[doc])[order].tolist(), which[order].tolist(), strict=True):
            spans[d].append((s, s + int(w.size[k])))
            items[d].update(w.items[k])
        merged = []
        for x in spans:
            out: list[list[int]] = []
            for s, e in sorted(x):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            merged.append([{"start": s, "stop": e} for s, e in out])
        return pa.RecordBatch.from_arrays([*(column(block, c) for c in names), pa.array(n), pa.array(merged, spans_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*names, "n_words", "spans", "items"])

    return map_blocks(docs.select(*(f"`{c}`" for c in names), "spans", "items"), run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Adds n_words, spans (merged, in words) and items (sorted ids) to ``docs``;
    its columns of these names are replaced.

    The benchmark is searched for in passes, each over so many items that what
    is sent to the executors stays within ``pass_bytes``.
    """
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").filter(F.col("text").isNotNull())
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-held // pass_bytes))
    found = docs.select(*(f"`{c}`" for c in names)).withColumns({"spans": F.expr("cast(array() as array<struct<start:long,stop:long>>)"), "items": F.expr("cast(array() as array<string>)")})
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(passes)) == p).collect()
        found = _pass(found, names, windows([(r.name, r.text) for r in part], width))
    return found


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: its words, those hit, and the items found."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")
