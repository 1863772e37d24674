"""What round 3's findings said may fail on larger tables: work and memory that grow with the input only."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanworks.functions import embedders, text
from gleanworks.operators import chunking, index
from gleanworks.plans import built, catalog  # noqa: F401  built adds to the catalog
from jobs import index_documents

D = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_data
def test_neighbours_copy_rows_by_whole_blocks(spark):
    """a table whose queries fit in one block isn't copied for blocks of 64 KB."""
    assert "CoGroups" not in plan(catalog.vector_neighbours(spark, D))


def test_scores_that_single_precision_cannot_tell_apart():
    """F1: pairs are ruled out in single precision, ranked in double; equal vectors by their ids."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=32)
    near = one + rng.normal(size=(3000, 32)) * 1e-9
    rows = np.concatenate([near, rng.normal(size=(3000, 32)), near[:50]])
    ids = rng.permutation(len(rows))
    q = index._unit(np.stack([one, rows[4000], near[7]]))
    best = index._Best(np.full(3, -1.0), 20)
    index._score(best, q, ids, pa.array(rows.tolist()))
    i, found, s = best.cut()
    want = np.round(np.einsum("qd,nd->qn", q, index._unit(rows)), index.DIGITS)
    for n in range(3):
        assert list(zip((-s[i == n]).tolist(), found[i == n].tolist(), strict=True)) == sorted(zip((-want[n]).tolist(), ids.tolist(), strict=True))[:20]


@needs_data
@pytest.mark.parametrize("name", ["html_blocks", "html_blocks_built"])
def test_pages_are_parsed_once(spark, name):
    """no second evaluation of the parser behind the explode's own filter."""
    ran = catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert ran.count("EvalPython") == 1


def test_slices_bound_what_is_held():
    """F3, F5, F8: Python objects are made of about a megabyte of a batch, whatever its rows hold."""
    seen = []

    def make(texts):
        seen.append(sum(len(t or "") for t in texts))
        return pa.array([len(t or "") for t in texts], pa.int64())

    rows = ["x" * 700_000, None, "", "y" * 3_000_000, *["z" * 5000] * 2000]
    got = text.by_slices(make, pa.int64(), pa.array(rows))
    assert got.to_pylist() == [len(t or "") for t in rows]
    assert sorted(seen)[-1] == 3_000_000 and sorted(seen)[-2] <= text.SLICE_BYTES
    assert text.by_slices(make, pa.int64(), pa.array([], pa.string())).to_pylist() == []


TEXTS = ["", None, "  ", "!? ?", "a", "The TCP protocol, the_protocol; x1 été naïve straße", "滑动窗口 sliding window 3.14 滑动窗口", "甲x乙", "ab " * 50]


@pytest.mark.parametrize("made", [embedders.hash_embedder, embedders.chinese_embedder])
def test_texts_are_embedded_together(made, monkeypatch):
    """blocks of texts give the vectors that each text gives alone, also when what is remembered is dropped."""
    e = made(64)

    def alone(t):
        v = np.zeros(64)
        for u in e.units(e.normalise(t or "")):
            for f, w in e.unit_features(u):
                i, sign = e.place(f)
                v[i] += sign * w
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()

    monkeypatch.setattr(embedders, "TOGETHER", 4)
    for most in (3, 200_000):
        monkeypatch.setattr(embedders, "REMEMBERED", most)
        embedders._PLACED.clear()
        assert e.matrix(TEXTS).tolist() == [alone(t) for t in TEXTS]
    assert e.matrix([]).shape == (0, 64)


def test_search_of_texts(spark):
    """F2, F3: vectors made where rows are scored find what stored ones find, and no vector of a row leaves the task."""
    e = embedders.hash_embedder(64)
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS * 2)], "chunk_id string, text string").filter("text IS NOT NULL")
    asked = spark.createDataFrame([(1, "protocol"), (2, "window 3.14"), (3, "")], "query_id long, text string").select("query_id", e.column(F.col("text")).alias("query_vector"))
    got = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))
    want = got(index.search(index.build(rows, e), asked, 4, 0.05))
    assert want and got(index.search(rows, asked, 4, 0.05, embedder=e)) == want
    assert got(index.search(rows, asked, 4, 0.05, embedder=e, query_bytes=64 * 8)) == want
    assert "EvalPython" not in plan(index.search(rows, asked, 4, 0.05, embedder=e))


def test_features_are_counted_from_lengths(monkeypatch):
    """the counts that listing the features gives, with no feature listed."""
    wanted = []
    for t in TEXTS:
        f = embedders.word_features(t or "")
        wanted.append((*(sum(x.startswith(k) for x, _ in f) for k in ("w:", "c2:", "c3:")), pytest.approx(sum(w for _, w in f))))
    monkeypatch.setattr(embedders, "word_unit_features", lambda unit: pytest.fail("listed"))
    assert [embedders.word_feature_counts(t or "") for t in TEXTS] == wanted


def test_frequent_words_stay_remembered(monkeypatch):
    """a stream of words that stand once doesn't drive out those that recur, and what is remembered is bounded."""
    asked, places = [], embedders.Embedder.places
    monkeypatch.setattr(embedders.Embedder, "places", lambda self, features: (asked.extend(features), places(self, features))[1])
    monkeypatch.setattr(embedders, "REMEMBERED", 50)
    monkeypatch.setattr(embedders, "TOGETHER", 4)
    embedders._PLACED.clear()
    e = embedders.hash_embedder(64)
    e.matrix([f"the protocol once{i} only{i}" for i in range(200)])
    units = embedders._PLACED[e.fingerprint]
    assert asked.count("w:the") == asked.count("w:protocol") == 1
    assert len(units.new) <= 50 and len(units.old) <= 50 and all(len(x) <= 50 for x in units.kinds.values())
    embedders._PLACED.clear()


def test_one_block_is_not_shuffled(spark):
    """a document of one block has its pieces numbered by the split, with the same chunks."""
    names = "doc_id string, source_id string, source_path string, file_type string, content_hash string, ingestion_fingerprint string, block_pos int, text string, extraction_method string, page_number int, heading_path array<string>, normalized_char_start int, warnings array<string>"
    texts = ["abcdefg. hijk lm. nop", "", None, " \n ", "x" * 40, "  tail. of words ; and more"]
    blocks = spark.createDataFrame([(f"d{i}", "s", "p", "txt", "h", "i", 0, t, "text", None, [], 0, []) for i, t in enumerate(texts)], names)
    cut = chunking.ChunkConfig(7, 2)
    one, every = chunking.chunk_blocks(blocks, cut, one_block=True), chunking.chunk_blocks(blocks, cut)
    assert sorted(map(str, one.collect())) == sorted(map(str, every.collect())) and one.count() > 10
    assert "Window" in plan(every) and "Window" not in plan(one)


def test_vectors_stay_where_they_are_made(spark, tmp_path, monkeypatch):
    """texts are dealt to tasks of bounded size before they are embedded, a task writes into one bucket, and lengths are told before the join."""
    monkeypatch.setattr(index_documents, "TASK_BYTES", 60)
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    spark.createDataFrame([(i, f"Text number {i} of some words." if i % 9 else None, "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(docs)
    found = index_documents.run(spark, docs, out, str(tmp_path / "mark"), {"dimension": 64, "buckets": 4})
    assert found.count() == sum(i % 9 > 0 for i in range(200))
    where = spark.read.parquet(f"{out}/chunks").select("bucket", "source_path", F.input_file_name().alias("file"), F.spark_partition_id().alias("p"))
    files = where.groupBy("file").agg(F.count_distinct("bucket").alias("b"), F.count("*").alias("n")).collect()
    assert {r.b for r in files} == {1} and len(files) > 4 * 4 and max(r.n for r in files) < 20
    assert where.filter(F.pmod(F.hash("source_path"), F.lit(4)) != F.col("bucket")).count() == 0
    lines = plan(found.select("chunk_id", "dimension")).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert not any("vector" in x for x in lines[: join + 1]) and any("size(vector" in x for x in lines[join:])
