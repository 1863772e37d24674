"""Archives: round trips, equal payloads, rolled files, equal bytes on every run."""

import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gleanworks.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two</p>"),
    (3, "http://a/ü x\r\n", "<p>one</p>"),
    (4, None, None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "Ünïcödé 日本語 \x00 \r\n\r\nWARC/1.1\r\n"),
    (7, "http://a/7", "<p>one</p>"),
    (2, "http://a/2", "<p>two</p>"),
    (2, "http://a/2b", "<p>one</p>"),
    (None, "http://a/null", "<p>one</p>"),
    (None, "http://a/null", "only without id"),
    (None, "http://b/null", "only without id"),
    (8, "http://a/8", "long " * 2_000_000),
]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(pages, least=0):
    last = {}
    for i, _, t in pages:
        if i is not None and len((t or "").encode()) >= least:
            last[t or ""] = max(last.get(t or "", i), i)
    out = Counter()
    for i, _, t in pages:
        to = last.get(t or "")
        again = to is not None and (i is None or i < to)
        out[i, len((t or "").encode()), digest(t), "revisit" if again else "response", to if again else None] += 1
    return out


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS shard", "'y' AS digest", "1 AS kind").repartition(3)


def test_round_trip(pages):
    got = Counter(map(tuple, warc.round_trip(pages).collect()))
    assert got == expected(PAGES)


def test_least_bytes(pages):
    got = Counter(map(tuple, warc.round_trip(pages, least_bytes=11).collect()))
    assert got == expected(PAGES, 11)


def test_string_ids(spark):
    rows = [("b\r\n%", "u", "x"), ("a", "u", "x"), ("é", "u", "x"), ("c", "u", "y")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {"b\r\n%": ("revisit", "é"), "a": ("revisit", "é"), "é": ("response", None), "c": ("response", None)}


def test_files(spark, tmp_path):
    """Files roll by compressed size, hold ranges in order, and are the same however rows are partitioned."""
    texts = [(i, f"http://a/{i}", hashlib.sha256(str(i if i % 3 else 0).encode()).hexdigest() * (1 + i % 40)) for i in range(400)]
    df = spark.createDataFrame(texts, "page_id long, url string, html string")
    for n, name in ((1, "a"), (7, "b")):
        warc.write(df.repartition(n), str(tmp_path / name), file_bytes=3000, shard_bytes=100_000)
    files = {n: {p.name: p.read_bytes() for p in sorted((tmp_path / n).glob("*.warc.gz"))} for n in "ab"}
    assert files["a"] == files["b"] and len(files["a"]) > 8
    manifest = {r.name: r for r in spark.read.json(str(tmp_path / "a" / "manifest")).collect()}
    assert manifest.keys() == files["a"].keys() and len({r.shard for r in manifest.values()}) > 3
    assert all(hashlib.sha256(files["a"][n]).hexdigest() == r.sha256 and len(files["a"][n]) == r.bytes for n, r in manifest.items())
    ids, last = [], {}
    for name in sorted(files["a"]):
        with gzip.open(tmp_path / "a" / name) as f:
            heads = [h for h, _ in warc.parse(f)]
        assert heads[0]["warc-type"] == "warcinfo" and heads[0]["warc-filename"] == name
        assert len(heads) - 1 == manifest[name].records
        ids += [int(h["x-page-id"]) for h in heads[1:]]
        last[name.split("-")[0]] = name
    assert ids == list(range(400))
    assert all(3000 <= r.bytes < 6500 for n, r in manifest.items() if n not in last.values())
    back = {r.page_id: (r.payload, r.url) for r in warc.read(spark, str(tmp_path / "a"), with_payload=True).filter("record_type = 'response'").collect()}
    assert all(back[str(i)] == (t.encode(), u) for i, u, t in texts if i % 3)
    urns = {r.record_id for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert len(urns) == 400
    with pytest.raises(ValueError):
        warc.write(df, str(tmp_path / "a"))


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "x"))
    (path,) = (tmp_path / "x").glob("*.warc.gz")
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"some text", b"some test")))
    assert [r.intact for r in warc.read(spark, str(tmp_path / "x")).collect()] == [False]


def test_moves_again_after_loss(tmp_path):
    """A file that an attempt has moved already isn't missed; one that is nowhere is an error."""
    import pyarrow as pa

    (tmp_path / "f.warc.gz").write_bytes(b"abc")
    row = lambda n: iter([pa.RecordBatch.from_pylist([{"held": "_temporary/t/f", "name": "f.warc.gz", "bytes": n}])])
    assert [b.to_pylist() for b in warc._move(row(3), str(tmp_path))] == [[{"name": "f.warc.gz"}]]
    with pytest.raises(FileNotFoundError):
        list(warc._move(row(4), str(tmp_path)))


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []
    assert warc.write(empty, str(tmp_path / "e")).collect() == [] and not list(Path(tmp_path / "e").glob("*.gz"))


def test_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    rows = [(i, t) for i, _, t in PAGES if i is not None and "\x00" not in (t or "")]
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP12_SQL})").fetchall()
    assert Counter(got) == expected([(i, None, t) for i, t in rows])
