"""WARC archives of pages, written in shards and read back.

Records are sorted by (page_id, payload) into ranges whose bounds are a function of the
rows alone: a sample chosen by hash, weighted by size. Payloads are compressed before the
shuffle; each shard is one sorted stream, rolled to a new file as soon as a file has its
compressed size. Digests and headers are made anew; of equal payloads one record is the
response, the others are revisits of it. Files are written under temporary names of each
task's attempt, the names of those that ended are a table, files are moved by it, and
the manifest is written last: a folder without one holds no archive.

Folders are addresses that Spark and ``pyarrow.fs`` both know (a path, file:, hdfs:, s3:).

Defined cases: a null payload is empty, and an empty one is a payload like any other; a null
page_id stands first, is smaller than all others and comes back as null; repeated rows
give a record each, with one id, all of the same kind, in one shard; if no row of a group of equal
payloads has a page_id, all are responses; a null url becomes ``urn:page:<id>``, and what
can't stand in a header is percent-encoded; an empty table gives a manifest without
files; columns besides page_id, url and the payload are not read; a page is handled
whole, whatever its size, one at a time.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, batch_rows, discard, join_hot, materialise, shared_dir, tidy

#: Payload bytes of a shard, unless there are SHARDS of them; rows of the sample for each.
SHARD_BYTES = 8 << 20
SHARDS = 20_000
SAMPLE = 16
#: Compressed bytes at which a file is full.
FILE_BYTES = 1 << 30

_SPACE = uuid.UUID("6f7f4c1e-93f1-5b43-9d8f-1d5e0f0c2a11")
_URI = "%!#$&'()*+,/:;=?@[]~"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = "shard int, digest string, kind int, url string, refers_to string, packed binary, payload_digest string, payload_bytes long"
_FILES = "shard int, part int, held string, name string, records long, bytes long, sha256 string"
#: What an archive's record gives back.
RECORD = "file string, record_id string, record_type string, page_id string, url string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


# ---- one record


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _urn(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{quote(str(page_id))}:{digest}')}>"


def _page(page_id, digest: str, url: str | None, payload: bytes | None, payload_bytes: int, payload_digest: str, date: str, refers_to: str | None = None) -> bytes:
    """A response, or (``payload`` None) a revisit of the page ``refers_to``."""
    name = None if page_id is None else quote(str(page_id))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", _urn(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=_URI) if url else f"urn:page:{name or ''}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Page-Id", name),
    ]
    if payload is None:
        more = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _urn(refers_to, digest)), ("X-Refers-To-Page-Id", quote(refers_to))]
        return _record("revisit", fields + more, http)
    return _record("response", fields, http + payload)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream of bytes."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head, stream.read(int(head.get("content-length", 0)))


# ---- where things lie


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    if address.startswith("file:") and not address.startswith("file://"):
        address = "file://" + address.removeprefix("file:")
    return pafs.FileSystem.from_uri(address)


def revisits(narrow: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of rows (page_id, digest, payload_bytes) those that revisit another: (page_id, digest, refers_to).
    ``narrow`` should be a written table."""
    rows = narrow.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "digest")
    groups = rows.groupBy("digest").agg(F.count("*").alias("many"), F.max("page_id").alias("last")).filter("many > 1 AND last IS NOT NULL")
    found = join_hot(rows, materialise(groups), "digest", "many").filter("page_id IS NULL OR page_id < last")
    return found.select("page_id", "digest", F.col("last").cast("string").alias("refers_to")).distinct()


def _place(page_id, digest: str) -> tuple:
    return (0, "", digest) if page_id is None else (1, page_id, digest)


def shard_bounds(narrow: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """The least (page_id, digest) of each shard but the first. At most SHARDS of them; the
    same for the same rows, however they are partitioned."""
    total = narrow.agg(F.count("*").alias("rows"), F.sum("payload_bytes").alias("bytes")).first()
    shards = min(SHARDS, -(-(total.bytes or 0) // shard_bytes))
    if shards < 2:
        return []
    one_in = max(1, total.rows // (shards * SAMPLE))
    # About shards * SAMPLE rows.
    some = narrow.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(one_in)) == 0).select("page_id", "digest", "payload_bytes").collect()
    some = sorted((_place(r.page_id, r.digest), r.payload_bytes) for r in some)
    whole, sofar, bounds = sum(n for _, n in some), 0, []
    for place, n in some:
        if sofar * shards >= whole * (len(bounds) + 1) and len(bounds) < shards - 1:
            bounds.append(place)
        sofar += n
    return sorted(set(bounds))


# ---- write


def write(pages: DataFrame, folder: str, payload: str = "html", least_bytes: int = 0, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes an archive of ``pages`` (page_id, url, ``payload``) into a new ``folder``; returns its
    manifest (shard, part, name, records, bytes, sha256), which is also its table ``manifest``.
    Payloads of fewer than ``least_bytes`` are never revisits."""
    spark = pages.sparkSession
    folder = folder.rstrip("/")
    fs, path = _open(folder)
    if fs.get_file_info(f"{path}/manifest").type != pafs.FileType.NotFound:
        raise ValueError(f"{folder} holds an archive")
    made: list[str] = []
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    own = pages.select("page_id", "url", raw.alias("payload"))
    narrow = materialise(own.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), made)
    marks = materialise(revisits(narrow, least_bytes), made)
    bounds = spark.sparkContext.broadcast(shard_bounds(narrow, shard_bytes))
    kind = dict(own.dtypes)["page_id"]
    row = f"page_id {kind}, {_ROW}"

    def packed(batches):
        for b in batches:
            rows, held = [], 0
            for r in range(b.num_rows):
                page_id, url, data = (b.column(k)[r].as_py() for k in range(3))
                digest, sha1 = hashlib.sha256(data).hexdigest(), sha1_base32(data)
                member = _page(page_id, digest, url, data, len(data), sha1, date)
                rows.append((page_id, bisect.bisect_right(bounds.value, _place(page_id, digest)), digest, 1, url, None, member, sha1, len(data)))
                held += len(member)
                if held >= BLOCK_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)
        tidy()

    def marked(batches):
        for b in batches:
            yield _batch([(p, bisect.bisect_right(bounds.value, _place(p, d)), d, 0, None, to, None, None, None) for p, d, to in zip(*(c.to_pylist() for c in b.columns), strict=True)], schema)

    def stored(batches):
        yield from _store(batches, folder, file_bytes, date)
        tidy()

    schema = _arrow(spark, row)
    sizes = narrow.agg(F.count("*"), F.sum("payload_bytes")).first()
    with batch_rows(spark, 4 * (sizes[1] or 0) // max(1, sizes[0])):
        rows = own.mapInArrow(packed, row).unionByName(marks.mapInArrow(marked, row))
        sorted_rows = rows.repartitionById(len(bounds.value) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
        files = materialise(sorted_rows.mapInArrow(stored, _FILES), made)
    moved = files.repartition(F.col("name")).mapInArrow(lambda batches: _move(batches, folder), "name string")
    materialise(moved, made)
    files.drop("held").orderBy("name").write.json(f"{folder}/manifest")
    discard(spark, *made, f"{folder}/_temporary")
    return spark.read.schema(files.drop("held").schema).json(f"{folder}/manifest")


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _File:
    """A file that is being written under a temporary name."""

    def __init__(self, folder: str, attempt: str, shard: int, part: int, date: str):
        fs, path = _open(folder)
        self.row = {"shard": shard, "part": part, "held": f"_temporary/{attempt}/{shard:05d}-{part:05d}", "name": f"{shard:05d}-{part:05d}.warc.gz"}
        fs.create_dir(f"{path}/_temporary/{attempt}", recursive=True)
        self.out, self.sha, self.bytes, self.records = fs.open_output_stream(f"{path}/{self.row['held']}", compression=None), hashlib.sha256(), 0, 0
        info = f"software: gleanworks\r\nformat: WARC File Format 1.1\r\nfilename: {self.row['name']}\r\n".encode()
        self.add(_record("warcinfo", [("WARC-Record-ID", _urn(self.row["name"], "")), ("WARC-Date", date), ("WARC-Filename", self.row["name"]), ("Content-Type", "application/warc-fields")], info))

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = self.row | {"records": self.records - 1, "bytes": self.bytes, "sha256": self.sha.hexdigest()}
        kinds = {"shard": pa.int32(), "part": pa.int32(), "records": pa.int64(), "bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()], list(row))


def _store(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows to files; a row of kind 0 says that the page's records with this payload are revisits."""
    attempt, file, part, mark = uuid.uuid4().hex, None, 0, None
    for b in batches:
        for k in range(b.num_rows):
            r = {n: b.column(j)[k].as_py() for j, n in enumerate(b.schema.names)}
            if r["kind"] == 0:
                mark = (r["page_id"], r["digest"], r["refers_to"])
                continue
            if file and (file.row["shard"] != r["shard"] or file.bytes >= file_bytes):
                part = part + 1 if file.row["shard"] == r["shard"] else 0
                yield file.close()
                file = None
            file = file or _File(folder, attempt, r["shard"], part, date)
            if mark and mark[:2] == (r["page_id"], r["digest"]):
                file.add(_page(r["page_id"], r["digest"], r["url"], None, r["payload_bytes"], r["payload_digest"], date, mark[2]))
            else:
                file.add(r["packed"])
    if file:
        yield file.close()


def _move(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Files get their names; one that has it already was moved by an attempt that was lost."""
    fs, path = _open(folder)
    for b in batches:
        for r in b.to_pylist():
            held, name = f"{path}/{r['held']}", f"{path}/{r['name']}"
            if fs.get_file_info(held).type != pafs.FileType.NotFound:
                fs.move(held, name)
            elif fs.get_file_info(name).size != r["bytes"]:
                raise FileNotFoundError(name)
        yield b.select(["name"])


# ---- read


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The page records of an archive's files, as its manifest lists them. ``intact``: the block has
    its digest, and a response's payload too. Bytes of a revisit's payload are those its HTTP header tells."""
    folder = folder.rstrip("/")
    files = spark.read.schema("name string, bytes long").json(f"{folder}/manifest")
    row = RECORD + ", payload binary" * with_payload
    schema = _arrow(spark, row)

    def run(batches):
        fs, path = _open(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f, gzip.open(f) as stream:
                    for r in _read(name, stream):
                        rows.append(r[: len(schema)])
                        held += 500 + len(r[-1] or b"") * with_payload
                        if held >= BLOCK_BYTES:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                yield _batch(rows, schema)
        tidy()

    some = files.select("name").repartition(max(1, min(SHARDS, files.count())), "name")
    return some.mapInArrow(run, row)


def _read(name: str, stream) -> Iterator[tuple]:
    for head, block in parse(stream):
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        told = next((int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")), 0)
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        intact = head.get("warc-block-digest") == f"sha1:{sha1_base32(block)}" and (kind == "revisit" or (told == len(payload) and digest == sha1_base32(payload)))
        page_id, to = (unquote(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id"))
        yield (name, head.get("warc-record-id"), kind, page_id, head.get("warc-target-uri"), to, told if kind == "revisit" else len(payload), digest, intact, payload if kind == "response" else None)


def round_trip(pages: DataFrame, payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes an archive of ``pages`` beside what else is shared, and reads it back; raises if a record isn't intact."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, payload, least_bytes)
    kind = dict(pages.dtypes)["page_id"]
    sound = F.when(F.col("intact"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    return read(spark, folder).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, sha1(h) AS s FROM p GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
