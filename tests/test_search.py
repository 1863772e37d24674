"""Exact search by brute force: ties, odd vectors, ids of both kinds, both ways to meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanworks.operators import index


def brute(rows, asked, k, least):
    out = []
    for q, v, own in asked:
        if v is None or not np.linalg.norm(v):
            continue
        found = []
        for i, w in rows:
            if w is not None:
                n = np.linalg.norm(w)
                s = round(float(np.dot(v, w) / (np.linalg.norm(v) * n)) if n else 0.0, 12)
                if s >= (least if own is None else own):
                    found.append((-s, i))
        out += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(df, name="chunk_id"):
    return sorted((r.query_id, r["rank"], r[name], round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    some = lambda: [float(x) for x in rng.integers(-1, 2, 4)]  # noqa: E731  few values: many ties
    rows = [(f"c{i:03d}é" if i % 2 else f"c{i:03d}", some()) for i in range(150)] + [("null", None), ("zero", [0.0] * 4)]
    asked = [(q, some(), None if q % 3 else 0.5) for q in range(70)] + [(70, None, None), (71, [0.0] * 4, None)]
    return rows, asked


@pytest.mark.parametrize("query_bytes,row_bytes", [(1 << 20, 1 << 20), (500, 900), (64, 1 << 20), (1 << 10, 32)])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_both_ways(spark, vectors, monkeypatch, query_bytes, row_bytes, kind):
    rows, asked = vectors
    df = spark.createDataFrame(rows, f"chunk_id string, vector array<{kind}>").repartition(3)
    q = spark.createDataFrame(asked, f"query_id long, query_vector array<{kind}>, min_score double").repartition(2)
    found = index.search(df, q, 5, 0.1, query_bytes=query_bytes, row_bytes=row_bytes)
    assert got(found) == brute(rows, asked, 5, 0.1)


def test_integer_ids_and_filters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, part int")
    q = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    for size in (1 << 20, 640):
        found = index.search(df, q, 4, where=F.col("part") == 1, id_col="id", query_bytes=size, row_bytes=400)
        assert got(found, "id") == brute([(i, v) for i, v, p in rows if p == 1], [(i, v, None) for i, v, _ in rows], 4, -1.0)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "query_id long, query_vector array<double>")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<double>")
    for size in (1 << 20, 16):
        assert index.search(none, asked, query_bytes=size).count() == 0
        assert index.search(rows, asked.limit(0), query_bytes=size).count() == 0
        assert index.search(rows, asked, 3, 1.1, query_bytes=size, row_bytes=16).count() == 0
        assert index.search(rows, asked, 3, 0.5, query_bytes=size, row_bytes=16).count() == 9


def test_best_in_tiles():
    """Candidates are cut while tiles arrive; what remains is the best of all."""
    rng = np.random.default_rng(3)
    scores = np.round(rng.normal(size=(7, 5000)), 1)
    ids = rng.permutation(5000)
    best = index._Best(np.full(7, -9.0), 6)
    for at in range(0, 5000, 13):
        best.add(scores[:, at : at + 13], ids[at : at + 13])
        assert best.held <= 1024 + 8 * 6 * 7 + 7 * 13
    i, found, s = best.cut()
    for q in range(7):
        want = sorted(zip((-scores[q]).tolist(), ids.tolist(), strict=True))[:6]
        assert list(zip((-s[i == q]).tolist(), found[i == q].tolist(), strict=True)) == want


def test_many_queries_are_not_collected(spark, monkeypatch):
    """Beyond ``query_bytes`` no query vector passes the driver, and the index is scanned once."""
    df = spark.range(3000).select(F.col("id"), F.array(*(F.rand(s) for s in range(4))).alias("vector"))
    q = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("collected"))
    found = index.search(df, q, 2, id_col="id", query_bytes=16 << 10, row_bytes=32 << 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3000") == 2 and "Join" not in plan.replace("CoGroup", "")
    assert found.count() == 6000
