"""Queries against their SQL on the smallest tables; commands end to end; streams."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanworks import cli
from gleanworks.plans import catalog
from gleanworks.streaming import adapters

D = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, D)
    names = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(names).collect())))
    sql = con.execute(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({catalog.SQL[name]})").fetchall()
    assert got == sorted(map(repr, sql))


@needs_data
def test_others_run(spark):
    for name in sorted(catalog.QUERIES.keys() - catalog.SQL.keys()):
        assert catalog.QUERIES[name](spark, D).count() > 0
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@needs_data
def test_holders(spark):
    items, docs = catalog.read(spark, D, "benchmark"), catalog.text_documents(spark, D)
    texts = {r.source_path: r.text for r in docs.collect()}
    want = {(i.item_id, p) for i in items.collect() for p, t in texts.items() if i.text in t}
    assert {tuple(r) for r in catalog.holders(items, docs).collect()} == want


@needs_data
def test_search_is_linear_in_queries(spark):
    """A batch of queries finds what each finds alone."""
    found, _ = catalog._text_search(spark, D)
    assert found.groupBy("query_id").count().filter("count > 5").count() == 0


def test_commands(spark, tmp_path, capsys):
    docs, ws = tmp_path / "docs", str(tmp_path / "ws")
    docs.mkdir()
    (docs / "a.md").write_text("# Attention\nQuery, key and value make attention.\n")
    (docs / "b.txt").write_text("A protocol controls transmission with windows.")
    run = lambda *a: (cli.main([*a, "--workspace", ws]), capsys.readouterr().out)
    assert run("init")[0] == 0
    code, out = run("ingest", str(docs))
    assert code == 0 and json.loads(out)["embedded"] == 2 and json.loads(out)["documents_added"] == 2
    (docs / "b.txt").write_text("Something else about routers.")
    (docs / "c.txt").write_bytes(b"\xff\x00\x01" * 99)
    code, out = run("ingest", str(docs), "--incremental")
    got = json.loads(out)
    assert code == 2 and (got["embedded"], got["reused"], got["chunks_generated"], got["chunks_reused"]) == (1, 1, 1, 1)
    assert [got[f"documents_{s}"] for s in ("added", "updated", "unchanged", "deleted", "failed")] == [0, 1, 1, 0, 1]
    (docs / "c.txt").write_text("A third text.")
    assert json.loads(run("ingest", str(docs), "--incremental")[1])["documents_added"] == 1
    (docs / "c.txt").unlink()
    got = json.loads(run("ingest", str(docs), "--incremental")[1])
    assert [got[f"documents_{s}"] for s in ("added", "updated", "unchanged", "deleted", "failed")] == [0, 0, 2, 1, 0]
    assert (got["documents"], got["embedded"], got["chunks_generated"]) == (2, 0, 0)
    code, out = run("search", "query key value")
    assert code == 0 and json.loads(out.splitlines()[0])["source_path"].endswith("a.md")
    assert "a.md" in run("ask", "query key value", "--dry-run")[1]
    (tmp_path / "s.jsonl").write_text(json.dumps({"query": "query key value", "relevant_source_paths": [str(docs / "a.md")]}) + "\n")
    assert json.loads(run("evaluate", str(tmp_path / "s.jsonl"), "--top-k", "1")[1])["recall_at_k"] == 1.0
    tasks = [{"id": "1", "query": "query key value", "relevant_source_paths": [str(docs / "a.md")], "expected_points": ["x"]}, {"id": "2", "query": "zzz", "task_type": "refusal"}]
    (tmp_path / "t.jsonl").write_text("".join(json.dumps(t) + "\n" for t in tasks))
    code, out = run("harness", str(tmp_path / "t.jsonl"))
    overall = next(r for r in map(json.loads, out.splitlines()) if r["section"] == "overall")
    assert code == 0 and overall["retrieval_hit_rate"] == overall["refusal_correct_rate"] == 1.0
    assert len(run("list-documents")[1].splitlines()) == 2
    assert run("rebuild-index")[0] == run("doctor")[0] == 0
    assert run("ingest", str(tmp_path / "none"))[0] == 2
    assert cli.main(["doctor", "--workspace", str(tmp_path / "no")]) == 1


def test_a_stream_into_the_store(spark, tmp_path):
    """A batch that is taken again after its version was made changes nothing; one that was lost before is made."""
    from gleanworks.sources.store import Store

    source, root, mark = tmp_path / "in", str(tmp_path / "ws"), tmp_path / "c"
    source.mkdir()
    run = lambda: adapters.store_files(spark, str(source), root, "files", str(mark)).awaitTermination()
    held = lambda name: {r.source_path.rsplit("/", 1)[1]: r.content_hash for r in Store(spark, root).read(name).collect()}
    (source / "a.txt").write_text("Text a.")
    (source / "b.md").write_text("# B\nText b.")
    run()
    store = Store(spark, root)
    assert store.version() == 1 and store.current()["notes"] == {"files": 0} and set(held("documents")) == {"a.txt", "b.md"}
    (source / "c.txt").write_text("Text c.")
    (source / "d.txt").write_bytes(b"\xff\x00\x01" * 99)
    run()
    assert store.version() == 2 and set(held("chunks")) == {"a.txt", "b.md", "c.txt"}
    assert [r.source_path[-5:] for r in store.read("failures").collect()] == ["d.txt"]
    before = store.current()
    for p in (mark / "commits").glob("*1*"):
        p.unlink()
    run()
    assert store.current() == before
    for p in (mark / "commits").glob("*1*"):
        p.unlink()
    for p in [p for p in (tmp_path / "ws" / "versions").iterdir() if "2.json" in p.name]:  # and its checksum
        p.unlink()
    run()
    assert store.version() == 2 and set(held("chunks")) == {"a.txt", "b.md", "c.txt"}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("x")
    seen = []
    adapters.watch_files(spark, str(source), lambda b: seen.extend(r.path for r in b.select("path").collect()), str(tmp_path / "c")).awaitTermination()
    assert len(seen) == 1
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "m"))
    q = adapters.histories(stream, 2).writeStream.format("memory").queryName("past").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "k")).start()
    q.awaitTermination()
    got = spark.table("past").filter(F.col("conv_id") == 1).first()
    assert [tuple(t) for t in got.turns] == [("m4", "m5"), ("m6", "m7")]
