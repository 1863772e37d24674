"""The jobs over growing copies, after losses, and from the command line."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from gleanworks.functions.embedders import hash_embedder
from gleanworks.operators.chunking import ChunkConfig, split_text
from jobs import evaluate_search, index_documents

SMALL = {"max_chars": 40, "overlap_chars": 8, "dimension": 64, "buckets": 4}
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, folder, rows):
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC).coalesce(1).write.mode("append").parquet(str(folder))


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in sorted(Path(folder).rglob("*.parquet"))}


def expected(rows, config=SMALL):
    """(path, start, end, text, lang) of the last version of each document."""
    last = {}
    for i, t, lang, s in rows:
        last[f"/docs/{s or ''}/{i}.txt"] = (t, lang)
    cut = ChunkConfig(config["max_chars"], config["overlap_chars"])
    return sorted((p, a, b, x, lang) for p, (t, lang) in last.items() for x, a, b in split_text(t or "", cut))


def got(df):
    return sorted((r.source_path, r.char_start, r.char_end, r.text, r.lang) for r in df.collect())


ONE = [(1, "The first text. It has a few words, and some more of them.", "en", "s"), (2, "Zwei.", "de", "s"), (3, "Three stays as it is.", "en", None), (4, "", "en", "t"), (5, "Five will go away.", "en", "t")]
TWO = [(1, "The first text has changed! " * 5, "fr", "s"), (3, "Three stays as it is.", "en", None), (5, None, "en", "t"), (6, "Six is new.", None, "t"), (7, None, "en", "t")]


def test_only_what_is_new(spark, tmp_path):
    docs, out, mark = tmp_path / "documents", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: index_documents.run(spark, str(docs), out, mark, SMALL)
    add(spark, docs, ONE)
    assert got(run()) == expected(ONE)
    before = files(out)
    assert got(run()) == expected(ONE) and files(out) == before
    add(spark, docs, TWO)
    df = run()
    assert got(df) == expected(ONE + TWO)
    after = files(out)
    assert before.items() <= after.items()
    status = {(r.source_path, r.batch): r.status for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert {k: v for k, v in status.items() if k[1] == 1} == {("/docs/s/1.txt", 1): "updated", ("/docs/t/5.txt", 1): "removed", ("/docs/t/6.txt", 1): "added"}
    assert {r.source_path: r.batch for r in df.collect()}["/docs//3.txt"] == 0
    made = hash_embedder(64)
    for r in df.collect():
        assert np.allclose(r.vector, made.embed(r.text))
    add(spark, docs, [(5, "Five is back.", "en", "t"), (2, "Zwei.", "de", "s")])
    assert ("/docs/t/5.txt", 2, "added") in {(r.source_path, r.batch, r.status) for r in (run(), spark.read.parquet(f"{out}/manifest"))[1].collect()}


def test_a_lost_batch_is_taken_again(spark, tmp_path):
    """A batch whose end wasn't noted, and one whose manifest is missing, give the same store."""
    docs, out, mark = tmp_path / "documents", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: index_documents.run(spark, str(docs), out, mark, SMALL)
    add(spark, docs, ONE)
    run()
    add(spark, docs, TWO)
    want = got(run())
    names = {k.rsplit("/", 1)[0] for k in files(out)}
    for half in (False, True):
        for p in Path(mark, "commits").glob("*1*"):
            p.unlink()
        if half:
            shutil.rmtree(Path(out, "manifest", "batch=1"))
        assert got(run()) == want == expected(ONE + TWO)
        assert {k.rsplit("/", 1)[0] for k in files(out)} == names


def test_odd_rows(spark, tmp_path):
    docs = tmp_path / "documents"
    add(spark, docs, [(None, "no id", "en", "s"), (1, "b", "en", "s"), (1, "a", "en", "s"), (1, "a", "en", "s"), (2, " \n ", "en", "s"), (3, "long " * 50_000, "en", "s"), (4, None, "en", "s")])
    df = index_documents.run(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "mark"), SMALL)
    best = max("ab", key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert got(df) == expected([(1, best, "en", "s"), (3, "long " * 50_000, "en", "s")])
    assert {r.status for r in spark.read.parquet(str(tmp_path / "out/manifest")).filter("source_path IS NULL").collect()} == {"rejected"}
    empty = tmp_path / "none"
    spark.createDataFrame([], DOC).write.parquet(str(empty))
    assert index_documents.run(spark, str(empty), str(tmp_path / "o"), str(tmp_path / "m"), SMALL).count() == 0


def test_other_settings(spark, tmp_path):
    """New files are taken with the new settings, and an unchanged text then counts as changed."""
    docs, out, mark = tmp_path / "documents", str(tmp_path / "out"), str(tmp_path / "mark")
    add(spark, docs, ONE)
    index_documents.run(spark, str(docs), out, mark, SMALL)
    add(spark, docs, ONE)
    config = SMALL | {"max_chars": 20}
    assert got(index_documents.run(spark, str(docs), out, mark, config)) == expected(ONE, config)


def brute_search(rows, k, queries):
    out = {}
    for i, v, label in rows:
        if i is None or not queries(i):
            continue
        found = []
        if v is not None and np.linalg.norm(v) > 0:
            for j, w, other in rows:
                if j is not None and w is not None and j != i:
                    n = np.linalg.norm(w)
                    found.append((-round(float(np.dot(v, w) / (np.linalg.norm(v) * n)) if n else 0.0, 12), j, other))
        top = sorted(found)[:k]
        places = [p for p, (_, _, other) in enumerate(top, 1) if label is not None and other == label]
        out[i] = (label, len(top), len(places), min(places, default=None), top[0][1] if top else None, round(-top[0][0], 6) if top else None)
    return out


def test_search_is_measured(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)], int(i % 3) if i % 7 else None) for i in range(60)]
    rows += [(60, None, 1), (None, [1.0] * 6, 1), (61, [0.0] * 6, 2)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
    want = brute_search(rows, 4, lambda i: i % 5 == 0)
    for _ in range(2):
        found = evaluate_search.run(spark, path, str(tmp_path / "out"), {"k": 4, "queries": "vec_id % 5 = 0"})
        assert {r.query_id: (r.label, r.found, r.relevant, r.first_relevant, r.best_id, r.best_score) for r in found.collect()} == want
    report = {r.get("label"): r for r in map(json.loads, "".join(p.read_text() for p in (tmp_path / "out/report").glob("*.json")).splitlines())}
    for label in (0, 1, 2, None):
        mine = [v for v in want.values() if v[0] == label]
        assert report[label]["queries"] == len(mine)
        assert report[label]["recall_at_k"] == pytest.approx(np.mean([v[2] > 0 for v in mine]))
        assert report[label]["precision"] == pytest.approx(np.mean([v[2] / v[1] if v[1] else 0 for v in mine]))
        assert report[label]["reciprocal_rank"] == pytest.approx(np.mean([1 / v[3] if v[3] else 0 for v in mine]))


def test_search_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e"))
    assert evaluate_search.run(spark, str(tmp_path / "e"), str(tmp_path / "out")).count() == 0


def test_command_lines(spark, tmp_path):
    add(spark, tmp_path / "documents", ONE)
    (tmp_path / "c.json").write_text(json.dumps(SMALL))
    spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e"))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    root = Path(__file__).parent.parent
    for args, said in ((["jobs.index_documents", "documents", "out", "mark", "--config", "c.json"], "read 5 rows"), (["jobs.evaluate_search", "e", "found"], "wrote 1 results")):
        where = [str(tmp_path / a) if i and not a.startswith("--") else a for i, a in enumerate(args)]
        done = subprocess.run([sys.executable, "-m", *where], cwd=root, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and said in done.stderr, done.stderr[-2000:]
    assert got(index_documents.current(spark, str(tmp_path / "out"))) == expected(ONE)
