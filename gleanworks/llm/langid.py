"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds those
of its letters, rotated by their place; a text's vector bundles (adds) its
trigrams'. A language's prototype bundles the unit vectors of its labelled
texts; what all prototypes share is taken off. A text gets the language whose
prototype has the largest cosine with its vector.

Letters are lower-cased; everything else counts as one space between words.

Defined cases: null text, or text without a letter, is ``und`` with score 0,
and so is everything if nothing could be learned; rows with null lang or null
doc_id aren't learned from; among equal cosines the first language by name
wins; repeated rows are learned from each, and predicted alike; an empty table gives
no rows; columns named as those that are added are replaced, all others are kept.
Texts are encoded whole, BATCH_CHARS or one text at a time, and a worker remembers
at most KNOWN vectors, so memory depends on the longest text alone (up to 2 GB).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, claim, column, map_blocks, strings, tidy

DIMENSIONS = 1024
#: Letters other than by chance have vectors of their own.
SYMBOLS, DENSE = 4096, 128
#: About so many labelled documents are learned from at most (drawn by a hash of doc_id).
LEARN_FROM = 24_000
#: Trigrams whose vectors a worker remembers, 4 KB each; others are bound anew, SLICE at a time.
KNOWN, SLICE = 20_000, 4000
#: Texts whose vectors are made at once.
BATCH_CHARS, BATCH_TEXTS = 400_000, 96
UNKNOWN = "und"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 if it's no letter. Those of Latin letters
    are 1 to DENSE - 1; all others share the rest."""
    out = np.zeros(0x110000, np.int16)
    dense: dict[int, int] = {}
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            if low < 0x180 and (low in dense or len(dense) < DENSE - 1):
                out[cp] = dense.setdefault(low, len(dense) + 1)
            else:
                out[cp] = DENSE + low * 2_654_435_761 % (SYMBOLS - DENSE)
    return out


class Encoder:
    """Vectors of texts, many at once."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.symbols = _symbols()
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
        self.letters = [np.roll(letters, k, 1) for k in (2, 1, 0)]
        self.row = np.full(DENSE**3, -1, np.int32)  # of a trigram of Latin letters, in `vectors`
        self.vectors = np.zeros((KNOWN, dimensions), np.float32)  # memory is taken as rows are filled
        self.known = 0

    def _bind(self, codes: np.ndarray, base: int) -> np.ndarray:
        a, b, c = codes // base // base, codes // base % base, codes % base
        return (self.letters[0][a] * self.letters[1][b] * self.letters[2][c]).astype(np.float32)

    def _add(self, out: np.ndarray, doc: np.ndarray, codes: np.ndarray, base: int) -> None:
        """Adds the vectors of trigrams that aren't remembered, each bound once."""
        each, place = np.unique(codes, return_inverse=True)
        for lo in range(0, len(each), SLICE):
            some = (place >= lo) & (place < lo + SLICE)
            n = min(SLICE, len(each) - lo)
            counts = np.bincount(doc[some] * n + place[some] - lo, minlength=len(out) * n).reshape(-1, n)
            out += counts.astype(np.float32) @ self._bind(each[lo : lo + n], base)

    def lettered(self, texts: list[str]) -> list[bool]:
        """Whether each text has a letter, where its vector isn't needed."""
        return [bool(self.symbols[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)].any()) for t in texts]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text has a letter, and the sum of its trigrams' vectors."""
        cp = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "replace"), np.uint32)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        s = self.symbols[cp]
        letter = s > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # a letter, or the first of what parts two words
        s, doc = np.concatenate([[0], s[keep], [0]]).astype(np.int64), doc[keep]
        has = np.bincount(doc, minlength=len(texts)) > 0
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        if not len(doc):
            return has, out
        a, b, c = s[:-2], s[1:-1], s[2:]
        own = (b > 0) | (doc == np.append(doc[1:], -1))  # what parts two texts is no middle
        a, b, c, doc = a[own], b[own], c[own], doc[own]
        latin = np.maximum(np.maximum(a, b), c) < DENSE
        codes = ((a * DENSE + b) * DENSE + c)[latin]
        row = self.row[codes]
        fresh = np.unique(codes[row < 0])[: KNOWN - self.known]
        if len(fresh):
            rows = self.known + np.arange(len(fresh))
            self.row[fresh] = rows
            self.vectors[rows] = self._bind(fresh, DENSE)
            self.known += len(fresh)
            row = self.row[codes]
        old = row >= 0
        if old.any():
            counts = np.bincount(doc[latin][old] * self.known + row[old], minlength=len(texts) * self.known).reshape(-1, self.known)
            used = np.flatnonzero(counts.any(0))
            out += counts[:, used].astype(np.float32) @ self.vectors[used]
        self._add(out, doc[latin][~old], codes[~old], DENSE)
        other = ~latin
        self._add(out, doc[other], (a[other] * SYMBOLS + b[other]) * SYMBOLS + c[other], SYMBOLS)
        return has, out


@lru_cache(1)
def worker_encoder(dimensions: int) -> Encoder:
    return Encoder(dimensions)


def encoder(dimensions: int) -> Encoder:
    """The worker's encoder, kept from task to task."""
    claim("langid", worker_encoder.cache_clear)
    return worker_encoder(dimensions)


def _batches(texts: list[str]) -> Iterator[slice]:
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and (held + len(t) > BATCH_CHARS or i - at == BATCH_TEXTS):
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if texts:
        yield slice(at, len(texts))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, bound: int = LEARN_FROM, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages, and their prototypes (one row each), from labelled rows of
    ``docs`` (doc_id, text, lang) that aren't held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = bound / max(bound, labelled.count())
    drawn = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def bundle(batches):
        own, sums = encoder(dimensions), {}
        for block in blocks(batches):
            texts, langs = strings(block), np.array(column(block, "lang").to_pylist(), object)
            for part in _batches(texts):
                _, v = own.bundle(texts[part])
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                for lang in set(langs[part]):
                    sums[lang] = sums.get(lang, 0) + v[langs[part] == lang].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "bundle": pa.array([v.tolist()], pa.list_(pa.float64()))})
        tidy()

    parts = drawn.select("lang", "text").mapInArrow(bundle, "lang string, bundle array<double>")
    # A language and dimension is one sum; rows: languages times dimensions.
    sums = parts.select("lang", F.posexplode("bundle").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in sums})
    made = np.zeros((len(langs), dimensions))
    for r in sums:
        made[langs.index(r.lang), r.d] = r.x
    made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
    return langs, made


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and has_letter, which doesn't depend on what was
    learned, to ``docs`` (its columns of those names are replaced)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "has_letter")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, has_letter boolean"
    dimensions = prototypes.shape[1]
    shared = prototypes.mean(0) if len(langs) > 1 else np.zeros(dimensions)
    shared = shared / max(np.linalg.norm(shared), 1e-9)
    own = prototypes - np.outer(prototypes @ shared, shared)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(block)
        pred, score, letters = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for part in _batches(texts):
            if not langs:
                letters[part] = encoder(dimensions).lettered(texts[part])
                continue
            has, v = encoder(dimensions).bundle(texts[part])
            letters[part] = has
            v = v - np.outer(v @ shared, shared)
            cosines = (v @ own.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            best = cosines.argmax(1)
            pred[part] = np.where(has, np.array(langs, object)[best], UNKNOWN)
            score[part] = np.where(has, np.clip(cosines.max(1), 0, 1), 0)
        return pa.RecordBatch.from_arrays([*(column(block, c) for c in names), pa.array(pred, pa.string()), pa.array(score), pa.array(letters)], [*names, "lang_pred", "score", "has_letter"])

    return map_blocks(docs.select(*(f"`{c}`" for c in names)), run, schema)


def identify(docs: DataFrame, bound: int = LEARN_FROM, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from ``docs``, then predict every row."""
    return predict(docs, *learn(docs, bound, dimensions))
