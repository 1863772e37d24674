"""The vector index: validation, build, update, exact top-k search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.text import strip
from . import remembered

SCHEMA_VERSION = 1
#: Bytes of query vectors sent to the executors at once; of a block of rows that meets one of queries.
QUERY_BYTES = 16 << 20
ROW_BYTES = 64 << 20
#: Scores held at once, of how many queries at most, and pairs that are scored exactly at once.
TILE, TALL, PAIRS = 4 << 20, 512, 16 << 10
#: Pairs of blocks for each core at least, where queries are cut into blocks.
PAIRS_PER_CORE = 4
#: Digits by which scores are ranked, so that equal vectors tie exactly.
DIGITS = 12


class IndexProblem(ValueError):
    """An index, or what should become one, breaks its contract."""


def check_rows(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """Counts of what is wrong with index rows (chunk_id, vector), in one pass."""
    d = F.lit(dimension) if dimension else F.size("vector")
    flat = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(strip(F.col("chunk_id").cast("string")) == "", F.lit(True))).alias("blank_ids"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated_ids"),
        F.count_if(F.coalesce(F.size("vector") != d, F.lit(True))).alias("wrong_size"),
        F.count_if(~F.coalesce(flat, F.lit(False))).alias("not_finite"),
        F.count_distinct(F.size("vector")).alias("dimensions"),
    )


def validate(rows: DataFrame, dimension: int | None = None) -> None:
    r = check_rows(rows, dimension).first()
    wrong = {k: r[k] for k in ("blank_ids", "repeated_ids", "wrong_size", "not_finite") if r[k]}
    if r.dimensions > 1:
        wrong["dimensions"] = r.dimensions
    if wrong:
        raise IndexProblem(f"index rows: {wrong}")


def check_provider(meta_fingerprint: str, meta_dimension: int, embedder) -> None:
    if meta_fingerprint != embedder.fingerprint or meta_dimension != getattr(embedder, "dimension", meta_dimension):
        raise IndexProblem(f"the index was made by {meta_fingerprint}, not {embedder.fingerprint}")


def normalise_chunks(chunks: DataFrame) -> DataFrame:
    """Raises unless every chunk has an id of its own and a text."""
    r = chunks.agg(
        F.count_if(F.coalesce(strip(F.col("chunk_id")) == "", F.lit(True))).alias("ids"),
        F.count_if(F.coalesce(strip(F.col("text")) == "", F.lit(True))).alias("texts"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated"),
    ).first()
    if r.ids or r.texts or r.repeated:
        raise IndexProblem(f"{r.ids} chunks without id, {r.texts} without text, {r.repeated} repeated ids")
    return chunks


def embed(chunks: DataFrame, embedder, memory: str | None = None) -> DataFrame:
    """``chunks`` with their vectors. A service that is paid for is asked once for each text: with ``memory``, a folder
    that all machines see, its answers are kept there and used again. Raises if it gave none for some texts."""
    if memory is None or not hasattr(embedder, "embed_batch"):
        return chunks.withColumn("vector", embedder.column(F.col("text")))
    found = remembered.answers(chunks.select("text"), embedder.embed_batch, embedder.fingerprint, memory, "array<double>")
    if bad := found.filter("failure IS NOT NULL").first():
        raise IndexProblem(f"texts without a vector, others are kept in {memory}: {bad.failure}")
    return chunks.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found.select("text_hash", F.col("value").alias("vector")), "text_hash").drop("text_hash")


def build(chunks: DataFrame, embedder, memory: str | None = None) -> DataFrame:
    """Chunks with their vector and its norm."""
    return embed(chunks, embedder, memory).withColumn("norm", vector.norm(F.col("vector")))


def meta(index: DataFrame, embedder) -> DataFrame:
    """One row about the index. Vectors are read only if the provider doesn't tell their size."""
    known = getattr(embedder, "dimension", None)
    size = F.coalesce(F.max(F.size("vector")), F.lit(0)) if known is None else F.when(F.count("*") > 0, F.lit(known)).otherwise(F.lit(0))
    return index.agg(F.count("*").alias("chunk_count"), size.alias("dimension")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(embedder.name).alias("provider_name"), F.lit(embedder.model).alias("provider_model"), F.lit(embedder.fingerprint).alias("provider_fingerprint"), "dimension", "chunk_count"
    )


def reusable(chunks: DataFrame, old: DataFrame) -> DataFrame:
    """``chunks`` with old_vector where text, hash and fingerprints are the same."""
    keys = ("text", "content_hash", "ingestion_fingerprint", "chunking_fingerprint")
    before = old.select("chunk_id", F.col("vector").alias("old_vector"), *(F.col(k).alias(f"old_{k}") for k in keys))
    same = F.col("text").eqNullSafe(F.col("old_text")) & F.col("content_hash").eqNullSafe(F.col("old_content_hash"))
    for k in keys[2:]:
        same = same & (F.coalesce(F.col(k), F.lit("")) == F.coalesce(F.col(f"old_{k}"), F.lit("")))
    joined = chunks.join(before, "chunk_id", "left")
    return joined.withColumn("old_vector", F.when(same, F.col("old_vector"))).drop(*(f"old_{k}" for k in keys))


def update(chunks: DataFrame, old: DataFrame, embedder, old_fingerprint: str | None = None, memory: str | None = None) -> DataFrame:
    """The index of ``chunks``; vectors of unchanged chunks are taken over. If the
    old index was made by another provider, all are made anew. ``reused`` says which."""
    if old_fingerprint is not None and old_fingerprint != embedder.fingerprint:
        return build(chunks, embedder, memory).withColumn("reused", F.lit(False))
    met = reusable(chunks, old)
    kept = met.filter(F.col("old_vector").isNotNull()).withColumnRenamed("old_vector", "vector")
    made = embed(met.filter(F.col("old_vector").isNull()).drop("old_vector"), embedder, memory)
    kept = kept.withColumn("reused", F.lit(True))
    both = kept.unionByName(made.withColumn("reused", F.lit(False)))
    return both.withColumn("norm", vector.norm(F.col("vector")))


def update_stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))


class _Best:
    """The best ids of each query, by (-score, id), from tiles of scores. At most TILE
    scores and a few times as many candidates as are asked for are held at once."""

    def __init__(self, least: np.ndarray, k: int):
        self.kth, self.k = least.astype(np.float64), k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, first: int = 0, slack: float = 0.0, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """``scores``: of queries from ``first`` on. If they may be off by ``slack``, those that
        may be among the best are scored anew by ``exact`` (places of queries and of ids)."""
        rows, wide = scores.shape
        kth = self.kth[first : first + rows]
        floor = lambda: np.clip(kth - slack, -2, 2).astype(scores.dtype)[:, None]
        above = scores >= floor()
        if wide > 4 * self.k and np.count_nonzero(above) > 4 * self.k * rows:
            # as many of this tile are as good as its k-th, so the k-th of all is no worse
            np.fmax(kth, np.partition(scores, -self.k, axis=1)[:, -self.k].astype(np.float64) - slack, out=kth)
            above = scores >= floor()
        at = np.flatnonzero(above)
        for some in np.split(at, range(PAIRS, len(at), PAIRS)):
            i, j = np.divmod(some, wide)
            found = scores[i, j] if exact is None else exact(i + first, j)
            keep = found >= kth[i]
            self.parts.append((i[keep] + first, ids[j[keep]], found[keep]))
            self.held += int(keep.sum())
            if self.held > 1024 + 8 * self.k * len(self.kth):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, i))
        i, ids, scores = i[order], ids[order], scores[order]
        first = np.searchsorted(i, np.arange(len(self.kth)))
        place = np.arange(len(i)) - first[i]
        last = place == self.k - 1
        self.kth[i[last]] = scores[last]
        keep = place < self.k
        self.parts = [(i[keep], ids[keep], scores[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _matrix(column) -> np.ndarray:
    """Unit vectors of a column of equally long lists."""
    v = pc.list_flatten(column)
    v = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)
    return _unit(v)


def _score(best: _Best, q: np.ndarray, ids: np.ndarray, column, matrix: Callable = _matrix) -> None:
    """All pairs are scored in single precision, whose error has a bound; only those that the bound can't rule out in double."""
    single, slack = q.astype(np.float32), (q.shape[1] + 8) * float(np.finfo(np.float32).eps)
    wide = max(1, min(TILE // min(max(1, len(q)), TALL), TILE // q.shape[1]))
    for at in range(0, len(ids), wide):
        some = matrix(column.slice(at, wide))
        turned, named = some.astype(np.float32).T, ids[at : at + wide]
        exact = lambda i, j: np.round(np.einsum("ij,ij->i", q[i], some[j]), DIGITS)  # noqa: B023, E731
        for first in range(0, len(q), TALL):
            best.add(single[first : first + TALL] @ turned, named, first, slack, exact)


def _found(asked, best: _Best, kind: pa.DataType, id_col: str) -> pa.RecordBatch | None:
    """``asked``: the ids of queries."""
    if not best.held:
        return None
    i, ids, scores = best.cut()
    return pa.RecordBatch.from_arrays([pa.array(asked.to_pylist(), asked.type).take(pa.array(i)), pa.array(ids.tolist(), kind), pa.array(scores, pa.float64())], ["query_id", id_col, "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 5, min_score: float = -1.0, where: Column | None = None, id_col: str = "chunk_id", query_bytes: int = QUERY_BYTES, row_bytes: int = ROW_BYTES, embedder=None) -> DataFrame:
    """The k nearest rows of each query by cosine, exactly.

    ``index``: id_col, vector. ``queries``: query_id, query_vector, and optionally
    min_score of its own. Filters reach the scan before scoring. Queries of up to
    ``query_bytes`` altogether are sent to the rows, which then don't move. More are cut
    into blocks of that size, rows into blocks of ``row_bytes``, and each pair of
    blocks is one task, whose size doesn't grow with either table. Either way only k rows a
    query and task are shuffled for the ranks. Ties go to the smaller id. Queries
    without length, and rows without a vector, find nothing and aren't found.
    With an ``embedder``, rows have a text in place of a vector; if queries are sent to
    them, vectors are made where they are scored and go nowhere else.
    """
    if where is not None:
        index = index.filter(where)
    own = F.coalesce("min_score", F.lit(min_score)) if "min_score" in queries.columns else F.lit(min_score)
    asked = queries.select("query_id", F.col("query_vector").alias("v"), own.cast("double").alias("least"))
    # Counted before they are embedded: a count reads no vectors, and one row tells how long they are.
    first = asked.select(F.size("v").alias("d")).filter("d > 0").first()
    width = 8 * (first.d if first else 1)
    blocks = -(-asked.count() * width // query_bytes)
    asked = asked.filter(F.coalesce(vector.norm(F.col("v").cast("array<double>")) > 0, F.lit(False)))
    made = embedder is not None and (blocks > 1 or not hasattr(embedder, "matrix"))
    if made:
        index = build(index, embedder)
    source = "vector" if embedder is None or made else "text"
    rows = index.select(F.col(id_col).alias("id"), source).filter(F.col(source).isNotNull())
    kind, qkind = rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, {id_col} {kind}, score double"
    if blocks < 2:
        sent = index.sparkSession.sparkContext.broadcast(asked.toArrow())  # query_bytes at most

        def score(batches):
            t = sent.value
            if not t.num_rows:
                return
            best, q, id_type = _Best(t["least"].to_numpy(), k), _matrix(t["v"]), pa.null()
            matrix = _matrix if source == "vector" else lambda texts: _unit(embedder.matrix(texts.to_pylist()))
            for batch in batches:
                id_type = batch.schema.field(0).type
                _score(best, q, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), matrix)
            if (out := _found(t["query_id"].combine_chunks(), best, id_type, id_col)) is not None:
                yield out

        found = rows.mapInArrow(score, schema)
    else:
        n = rows.count()
        against = max(1, -(-n * width // row_bytes), min(n, -(-PAIRS_PER_CORE * index.sparkSession.sparkContext.defaultParallelism // blocks)))

        def meet(t: pa.Table, some: pa.Table) -> pa.Table:
            best = _Best(t["least"].to_numpy(), k)
            if t.num_rows and some.num_rows:
                _score(best, _matrix(t["v"]), some["id"].to_numpy(), some["vector"])
            out = _found(t["query_id"].combine_chunks(), best, some.schema.field("id").type, id_col)
            return pa.Table.from_batches([out]) if out is not None else pa.table([t["query_id"].slice(0, 0), some["id"].slice(0, 0), pa.array([], pa.float64())], ["query_id", id_col, "score"])

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = asked.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")}).withColumn("rb", every(against))
        met = rows.withColumns({"rb": F.pmod(F.xxhash64("id"), F.lit(against)).cast("int")}).withColumn("qb", every(blocks))
        found = dealt.groupBy("qb", "rb").cogroup(met.groupBy("qb", "rb")).applyInArrow(meet, schema)
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    top = found.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k)
    return F.broadcast(top) if blocks < 2 else top  # k rows for each of the queries that were sent


def search_results(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts and metadata are joined back for what was found only."""
    names = [c for c in ("doc_id", "source_path", "file_type", "text", "page_start", "page_end", "heading_path", "extraction_methods", "warnings") if c in chunks.columns]
    return found.join(chunks.select("chunk_id", *names), "chunk_id").withColumn("score", F.round("score", 8))
