"""Stored snapshots: buckets, races, and the commands that write them."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanworks import cli
from gleanworks.sources.store import LostRace, Store, bucket

ROW = "source_path string, v long"


def at(store, name="t"):
    return store.current()["tables"][name]["at"]


def test_one_source_rewrites_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 16)
    many = spark.range(10_000).select(F.concat(F.lit("/a/"), "id").alias("source_path"), F.col("id").alias("v"))
    assert store.version() == 0 and store.write({"t": many, "one": spark.range(1), "keep": many}, 0) == 1
    before, files = at(store), {p for p in Path(tmp_path, "s").rglob("*.parquet")}
    assert len(before) == 16
    (b,) = [r.b for r in many.filter("v = 77").select(bucket(F.col("source_path"), 16).alias("b")).collect()]
    changed = store.read("t", [b]).withColumn("v", F.when(F.col("v") == 77, -1).otherwise(F.col("v")))
    assert store.write({"t": changed}, 1, {"t": [b]}) == 2
    after = at(store)
    assert {k for k in after if after[k] != before[k]} == {str(b)}
    fresh = {p for p in Path(tmp_path, "s").rglob("*.parquet")} - files
    assert len(fresh) == 1 and f"_bucket={b}/" in str(fresh)
    want = {(f"/a/{i}", -1 if i == 77 else i) for i in range(10_000)}
    assert {tuple(r) for r in store.read("t").collect()} == want and store.read("keep").count() == 10_000
    assert {tuple(r) for r in store.read("t", [b]).collect()} == {x for x in want if x[0] in {r.source_path for r in changed.collect()}}


def test_buckets_that_run_empty(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    none = spark.createDataFrame([], ROW)
    store.write({"t": none, "meta": spark.createDataFrame([], "x int")}, 0)
    assert store.read("t").collect() == [] and at(store) == {}
    store.write({"t": spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], ROW)}, 1)
    (b,) = [r.b for r in spark.createDataFrame([("a",)], "p string").select(bucket(F.col("p"), 4).alias("b")).collect()]
    rest = {tuple(r) for r in store.read("t").collect()} - {tuple(r) for r in store.read("t", [b]).collect()}
    store.write({"t": none}, 2, {"t": [b]})
    assert {tuple(r) for r in store.read("t").collect()} == rest
    assert Store(spark, str(tmp_path / "s"), 99).buckets == 4


def test_a_lost_race_is_an_error(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("x", 1)], ROW)
    a.write({"t": df}, 0)
    with pytest.raises(LostRace):
        b.write({"t": df}, 0)
    # Both begin at 1; the other one ends while this one writes.
    store = b._store

    def slow(rows, folder):
        a.write({"t": df.withColumn("v", F.lit(5))}, 1)
        return store(rows, folder)

    monkeypatch.setattr(b, "_store", slow)
    with pytest.raises(LostRace):
        b.write({"t": df}, 1)
    assert a.version() == 2 and [r.v for r in a.read("t").collect()] == [5]
    assert len(list(Path(tmp_path, "s", "data").iterdir())) == 2  # nothing of the loser stays


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write({"t": spark.createDataFrame([("x", 1)], ROW)}, 0)
    bad = spark.createDataFrame([("x", 2)], ROW).withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.write({"t": bad}, 1)
    assert store.version() == 1 and [r.v for r in store.read("t").collect()] == [1]
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none")).read("t")


@pytest.fixture
def run(tmp_path, capsys):
    ws = str(tmp_path / "ws")

    def go(*args):
        code = cli.main([*args, "--workspace", ws])
        out = capsys.readouterr().out
        return code, json.loads(out) if out.startswith("{") and out.count("\n") == 1 else out

    return go


def test_commands_over_a_changing_folder(spark, tmp_path, run):
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(5):
        (docs / f"{i}.txt").write_text(f"Text number {i} about protocols.")
    (docs / "blank.md").write_text(" \n\n")
    _, first = run("ingest", str(docs))
    assert (first["documents"], first["documents_added"], first["embedded"]) == (6, 6, 5)
    # A blank file is a document, and not new again.
    _, again = run("ingest", str(docs), "--incremental")
    assert (again["documents_added"], again["documents_updated"], again["documents_unchanged"], again["embedded"], again["reused"]) == (0, 0, 6, 0, 5)
    # One changed file: its bucket alone is written.
    (docs / "3.txt").write_text("Changed.")
    store = Store(spark, str(tmp_path / "ws"))
    before = {n: at(store, n) for n in ("chunks", "index", "documents")}
    _, third = run("ingest", str(docs), "--incremental")
    assert (third["documents_updated"], third["embedded"], third["reused"]) == (1, 1, 4)
    (b,) = [str(r.b) for r in spark.createDataFrame([(str(docs / "3.txt"),)], "p string").select(bucket(F.col("p"), store.buckets).alias("b")).collect()]
    assert all({k for k, p in at(store, n).items() if before[n].get(k) != p} == {b} for n in before)
    # Another provider: all vectors are made anew, and the index is sound.
    code, other = run("ingest", str(docs), "--incremental", "--embedding", "chinese")
    assert code == 0 and (other["embedded"], other["reused"]) == (5, 0)
    assert {len(r.vector) for r in store.read("index").select("vector").collect()} == {512}
    code, meta = run("doctor")
    assert code == 0 and (meta["provider_fingerprint"], meta["dimension"], meta["chunk_count"]) == ("chinese:chinese-ngram-v1:d512", 512, 5)
    assert run("search", "protocols")[0] == 0
    code, said = run("ask", "protocols", "--retrieval-only", "--json", "--max-context-chars", "120")
    assert code == 0 and said["question"] == "protocols" and said["answer"] == said["context"] and len(said["context"]) <= 120
    # Without --incremental nothing of the old version stays.
    (docs / "0.txt").unlink()
    _, plain = run("ingest", str(docs))
    assert plain["documents"] == 5 and not any(r.source_path.endswith("0.txt") for n in ("chunks", "index", "documents") for r in store.read(n).select("source_path").collect())


def test_doctor_finds_vectors_of_another_provider(spark, tmp_path, run):
    (tmp_path / "a.txt").write_text("Some text.")
    run("ingest", str(tmp_path / "a.txt"))
    store = Store(spark, str(tmp_path / "ws"))
    assert run("doctor")[0] == 0
    store.write({"meta": store.read("meta").withColumn("provider_fingerprint", F.lit("chinese:chinese-ngram-v1:d512"))}, store.version())
    assert run("doctor")[0] == 1
    store.write({"meta": store.read("meta").withColumns({"provider_fingerprint": F.lit("hash:hash-v1:d384"), "chunk_count": F.lit(7).cast("long")})}, store.version())
    assert run("doctor")[0] == 1


def test_each_command_has_its_own_options(capsys):
    p = cli.parser()
    args = p.parse_args(["chat", "--max-steps", "3", "--history-max-turns", "5", "--retrieval-only"])
    assert (args.max_steps, args.history_max_turns, args.retrieval_only, args.min_score) == (3, 5, True, 0.08)
    assert p.parse_args(["search", "q"]).min_score == 0.0
    assert p.parse_args(["ingest", "x", "--embedding-provider", "chinese", "--embedding-dimensions", "64"]).dimension == 64
    for wrong in (["search", "q", "--crawl"], ["doctor", "--top-k", "3"], ["ask", "q", "--delay", "1"], ["ingest"]):
        with pytest.raises(SystemExit):
            p.parse_args(wrong)
    capsys.readouterr()
