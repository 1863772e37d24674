"""Snapshots of tables in buckets of sources.

A table's rows lie by a hash of source_path in plain partitioned Parquet folders. A version
is a small JSON file that names, for each table and bucket, the folder that holds it;
one that changes a few sources writes their buckets only and goes on naming the others'
old folders. The file appears under its name at once or not at all, so a reader never sees tables of different
versions; a writer says which version it began from, and an error tells it if another
one was there first. Files are reached through Spark's file system, wherever they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class LostRace(ValueError):
    """Another writer has made the next version."""


def bucket(source_path: Column, buckets: int = BUCKETS) -> Column:
    """Where a source lies: the first 32 bits of its SHA-256."""
    return (F.conv(F.substring(F.sha2(source_path, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


class Store:
    """Tables with a column source_path are cut into buckets; others are one piece (bucket 0)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, str(root).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path(self.root)
        self._fs = path.getFileSystem(self._conf)
        self.root = str(path.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString())
        self.buckets = (self.current() or {"buckets": buckets})["buckets"]

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> int:
        """0: nothing is stored."""
        return max([int(n[:-5]) for n in self._names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def current(self) -> dict | None:
        """The version's description."""
        n = self.version()
        if not n:
            return None
        stream = self._fs.open(self._path(f"{self.root}/versions/{n:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table as it stands, or some of its buckets."""
        at = self.current()
        if at is None:
            raise FileNotFoundError(f"nothing is stored in {self.root}")
        return self._table(at["tables"][name], only)

    def _table(self, table: dict, only: Iterable[int] | None = None) -> DataFrame:
        wanted = None if only is None else {str(b) for b in only}
        paths = [f"{self.root}/{p}" for b, p in sorted(table["at"].items()) if wanted is None or b in wanted]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], expected: int, only: dict[str, Iterable[int]] | None = None, notes: dict[str, int] | None = None) -> int:
        """The version after ``expected``. ``only``: of these tables just these buckets are replaced, and
        the rows given are theirs; other tables given are replaced whole, those not given stay. A
        table may be a function: it is given one that reads the tables before it as they were just written.
        ``notes`` are kept with the version, and those of earlier ones with it: how far a stream was, say."""
        before = self.current() or {"tables": {}, "version": 0}
        if before["version"] != expected:
            raise LostRace(f"version {before['version']} is there; this began from {expected}")
        n, folder = expected + 1, f"data/{expected + 1:08d}-{uuid.uuid4().hex[:8]}"
        after = dict(before["tables"])
        try:
            for name, df in tables.items():
                df = df(lambda x: self._table(after[x])) if callable(df) else df
                some = (only or {}).get(name)
                kept = {} if some is None or name not in after else {b: p for b, p in after[name]["at"].items() if int(b) not in set(some)}
                after[name] = {"schema": df.schema.jsonValue(), "at": kept | self._store(df, f"{folder}/{name}")}
            self._publish({"version": n, "buckets": self.buckets, "tables": after, "notes": before.get("notes", {}) | (notes or {})}, n)
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        return n

    def _store(self, df: DataFrame, folder: str) -> dict[str, str]:
        """Writes rows by bucket; the folders that were made."""
        where = bucket(F.col("source_path"), self.buckets) if "source_path" in df.columns else F.lit(0)
        rows = df.withColumn("_bucket", F.coalesce(where, F.lit(0)))
        if "source_path" in df.columns:  # large buckets are split by size
            rows = rows.hint("rebalance", "_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {x.partition("=")[2]: f"{folder}/{x}" for x in self._names(f"{self.root}/{folder}") if x.startswith("_bucket=")}

    def _publish(self, about: dict, n: int) -> None:
        """A file of its own gets the version's name, unless there is one."""
        held, name = (self._path(f"{self.root}/versions/{x}") for x in (f".{uuid.uuid4().hex}", f"{n:08d}.json"))
        stream = self._fs.create(held, True)
        stream.write(bytearray(json.dumps(about).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(held, name, options)
        except Exception as e:
            self._fs.delete(held, False)
            if self._fs.exists(name):
                raise LostRace(f"version {n} is there") from e
            raise
