"""What models were asked before is not asked again.

Answers lie in a table by the model's fingerprint and the text's SHA-256, in plain Parquet, a folder for each call. A call
asks only for texts that have no answer there, each once however often it stands; what it gets is written
before anything else is done with it, so that neither a lost executor (one task's texts at most) nor a later
failure pays twice. A service's errors are rows, with the reason, and those texts are asked again next time.

Defined cases: a null text is an empty one; equal texts share one answer; an answer of a wrong number of items
is an error of its batch; if a batch fails for good, its texts are tried one by one, so that one bad
text fails alone, until three in a row have failed; two calls at a time may both ask for a text, and the answer of
the one with the smaller name counts; an empty table asks nothing.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts and bytes of a request; texts of a task, which is what a lost executor may ask for again.
BATCH_ROWS = 64
BATCH_BYTES = 256 << 10
TASK_ROWS = 2000
#: Times that a request is made, and seconds before the second time; they double from then on.
TRIES = 4
WAIT = 1.0


def _persist(ask: Callable[[list[str]], list], texts: list[str], tries: int, wait: float) -> list[tuple]:
    """(value, failure) of each text."""
    error = None
    for k in range(tries):
        try:
            got = list(ask(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
            return [(v, None) for v in got]
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    if len(texts) == 1:
        return [(None, error)]
    out: list[tuple] = []
    for t in texts:
        dead = len(out) > 2 and all(v is None for v, _ in out[-3:])
        out += [(None, out[-1][1])] if dead else _persist(ask, [t], 1, wait)
    return out


def _batches(texts: list[str], rows: int, most: int) -> Iterator[tuple[int, int]]:
    at = held = 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if i > at and (i - at >= rows or held + n > most):
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def answers(texts: DataFrame, ask: Callable[[list[str]], list], fingerprint: str, path: str, kind: str = "string", rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """(text_hash, value, failure) of each different text of ``texts`` (a column text). ``ask`` takes texts and
    gives as many values of Spark's type ``kind``; ``path`` is a folder that all machines see."""
    spark = texts.sparkSession
    where = f"{path.rstrip('/')}/{hashlib.sha256(fingerprint.encode()).hexdigest()[:32]}"
    schema = f"text_hash string, value {kind}, failure string, call string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{where}/call-0")
    # Each call has a folder: Spark takes two scans of one folder in a plan for the same, whatever has been added between them.
    known = lambda: spark.read.schema(schema).parquet(f"{where}/call-*")
    text = F.coalesce("text", F.lit(""))
    asked = texts.select(F.sha2(text, 256).alias("text_hash"), text.alias("text")).groupBy("text_hash").agg(F.first("text").alias("text"))
    missing = asked.join(known().filter("failure IS NULL").select("text_hash"), "text_hash", "left_anti")
    call = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = f["text"].tolist()
            for a, b in _batches(said, rows, most_bytes):
                got = _persist(ask, said[a:b], tries, wait)
                yield pd.DataFrame({"text_hash": f["text_hash"].tolist()[a:b], "value": [v for v, _ in got], "failure": [e for _, e in got], "call": call})

    n = missing.count()  # of hashes: nothing is asked for it
    if n:
        missing.repartition(-(-n // TASK_ROWS), "text_hash").mapInPandas(run, schema).write.parquet(f"{where}/call-{call}")
    good = known().filter("failure IS NULL").groupBy("text_hash").agg(F.min_by("value", "call").alias("value")).withColumn("failure", F.lit(None).cast("string"))
    bad = known().filter((F.col("call") == call) & F.col("failure").isNotNull()).select("text_hash", "value", "failure")
    wanted = asked.select("text_hash")
    return wanted.join(good.unionByName(bad.join(good.select("text_hash"), "text_hash", "left_anti")), "text_hash")
