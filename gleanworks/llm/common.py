"""What the corpus operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (a longer single text is one block).
BLOCK_BYTES = 4 << 20

#: Rows of an Arrow batch; each may hold a whole text.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. Arrow batches get few rows from here on,
    since a row's size has no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``,
    or one of our own where it is unset and all runs in one process, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):  # a folder of one machine would lose rows
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gleanworks-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor. The files go
    when the driver ends; paths are also appended to ``keep`` so that a caller
    can ``discard`` them sooner.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    path = f"{shared_dir(spark)}/gleanworks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, bytes_per_row: int, most_bytes: int = 32 << 20):
    """While it lasts, Arrow batches hold at most so many bytes (what runs must be eager)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, max(1, min(BATCH_ROWS, most_bytes // max(1, bytes_per_row))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``materialise`` wrote, by Spark's own file system."""
    try:
        jvm = spark.sparkContext._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone when the driver ends
        pass


#: A key is hot if it holds more than one in so many rows; so many keys are at most.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, info: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with one row of ``info`` per key. ``weight``: rows of
    a key. The hot keys, at most HOT_SHARE of them, are broadcast, so that no
    task gets a key's rows; all others are joined by a shuffle. Both sides should
    be written tables, since they are read twice."""
    total = info.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > total
    near = info.filter(hot)
    return rows.join(F.broadcast(near), key).union(rows.join(F.broadcast(near.select(key)), key, "left_anti").join(info.filter(~hot), key))


def join_spread(rows: DataFrame, info: DataFrame, key: str, *by: str, weight: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with one row of ``info`` per key, where that row may be
    wide, so that not even hot ones should be broadcast. The rows of a hot key are
    dealt by ``by`` over so many salts that none has more than one in HOT_SHARE of
    all rows, and its row of ``info`` is copied as often: HOT_SHARE copies more at most.
    ``weight``: a column of ``info`` that says how many rows a key has; else they are
    counted. What isn't counted here should be a written table."""
    many = info.select(key, F.col(weight).alias("many")) if weight else rows.groupBy(key).agg(F.count("*").alias("many"))
    total = many.agg(F.sum("many"), F.max("many")).first()
    if not total[0] or total[0] < HOT_SHARE or total[1] * HOT_SHARE <= total[0]:
        return rows.join(info, key)
    # Rows: at most HOT_SHARE keys.
    hot = F.broadcast(materialise(many.filter(F.col("many") * HOT_SHARE > F.lit(total[0])).select(key, F.ceil(F.col("many") * HOT_SHARE / F.lit(total[0])).cast("int").alias("salts"))))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("salts")
    copied = info.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


#: Bits of a filter that is broadcast as a table of words: at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 25


def filter_words(hashes: DataFrame, made: list[str] | None = None) -> DataFrame:
    """A filter of fixed size over ``hashes`` (h, 64 bits): its words, a written table."""
    bit = hashes.select(F.pmod("h", F.lit(FILTER_BITS)).alias("b"))
    words = bit.groupBy(F.expr("b div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS INT))")).alias("held"))
    return materialise(words, made)


def in_filter(rows: DataFrame, words: DataFrame, h: Column, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether the filter may hold ``h``."""
    b = F.pmod(h, F.lit(FILTER_BITS))
    met = rows.withColumns({"word": F.floor(b / 64).cast("long"), "bit": F.pmod(b, F.lit(64)).cast("int")}).join(F.broadcast(words), "word", "left")
    hit = F.expr("coalesce(shiftrightunsigned(held, bit) & 1L, 0L) = 1L")
    return met.withColumn(name, hit).drop("word", "bit", "held")


def release(spark: SparkSession) -> None:
    """Shuffle files of what has been written are removed when the driver's JVM finds
    that nothing refers to them; in a loop of many jobs it is asked to look."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _cut(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    col = batch.column(batch.schema.get_field_index(text))
    if col.nbytes <= most:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most`` bytes of text. After
    every BLOCK_BYTES or so, memory that is free by then goes back to the system."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        for block in _cut(batch, text, most):
            yield block
            done += block.column(block.schema.get_field_index(text)).nbytes
            if done >= BLOCK_BYTES:
                done = 0
                tidy()


_claimed: list = ["", lambda: None]


def claim(owner: str, clear: Callable[[], None]) -> None:
    """A worker remembers things for one operator at a time: when another begins,
    what the one before remembered is cleared."""
    if _claimed[0] != owner:
        _claimed[1]()
        _claimed[:] = [owner, clear]


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system; the worker
    lives on, beside an executor that may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", most: int = BLOCK_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` of a function from one block to one batch; ``after`` runs when a task ends."""

    def run(batches):
        for block in blocks(batches, text, most):
            yield fn(block)
        if after:
            after()
        tidy()

    return df.mapInArrow(run, schema)


def strings(block: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column; null is empty."""
    return [x or "" for x in block.column(block.schema.get_field_index(name)).to_pylist()]


def column(block: pa.RecordBatch, name: str) -> pa.Array:
    return block.column(block.schema.get_field_index(name))
