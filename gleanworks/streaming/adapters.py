"""Continuous ingestion and per-conversation state.

Neither adds semantics of its own: arriving files go through the batch merge,
and histories keep the last completed turns, as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunking, incremental
from ..sources import files
from ..sources.store import Store, bucket

_FILE = "path string, modificationTime timestamp, length long, content binary"


def _stream(spark: SparkSession, path: str) -> DataFrame:
    # The source would forget files older than a week beside newer ones.
    return spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFileAge", "36500d").load(path)


def watch_files(spark: SparkSession, path: str, merge: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each batch of new files is given to ``merge`` once (the merge replaces
    whole sources, so a batch given twice changes nothing)."""
    return _stream(spark, path).writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_files(spark: SparkSession, path: str, root: str, name: str, checkpoint: str, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> StreamingQuery:
    """New files below ``path`` become documents and chunks of the store at ``root``, bucket by bucket. The
    version that a batch makes notes its number under the stream's ``name``: a batch that is taken again
    after its version was made changes nothing. Files that can't be read are rows of failures of their batch."""
    store = Store(spark, root)

    def take(batch: DataFrame, n: int) -> None:
        at = store.current() or {"version": 0, "tables": {}}
        if at.get("notes", {}).get(name, -1) >= n:
            return
        held = batch.persist()  # hashed, decoded and listed from one read; what is lost is read again
        try:
            found = files.load_files(held.select("path", "length", "content"), path)
            fresh = found.filter(F.col("loaded.error_type").isNull())
            classes = fresh.select("source_path", F.lit("updated").alias("status")).distinct()
            blocks = files.file_blocks(fresh)
            chunks = chunking.chunk_blocks(blocks, config)
            named = fresh.select("doc_id", "source_id", "source_path", "file_type", "content_hash", "ingestion_fingerprint").withColumn("warnings", F.array().cast("array<string>"))
            documents = chunking.manifest(named, blocks, chunks).withColumn("chunking_fingerprint", F.lit(config.fingerprint))
            touched = [r.b for r in classes.select(bucket(F.col("source_path"), store.buckets).alias("b")).distinct().collect()]  # at most all buckets
            tables = {"chunks": chunks, "documents": documents}
            if at["version"]:
                tables = {t: incremental.merge(store.read(t, touched), df, classes) for t, df in tables.items()}
            store.write(tables | {"failures": files.failures(found)}, at["version"], {"chunks": touched, "documents": touched}, {name: n})
        finally:
            held.unpersist()

    return _stream(spark, path).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keep_last(n: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, waiting = state.get if state.exists else ([], None)
        turns = [tuple(t) for t in turns]
        for batch in batches:
            for m in batch.sort_values("turn").itertuples():
                if m.role == "user":
                    waiting = m.text.strip()
                elif m.role == "assistant" and waiting and m.text.strip():
                    turns, waiting = [*turns, (waiting, m.text.strip())][-n:], None
        state.update(([list(t) for t in turns], waiting))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[{"user": u, "assistant": a} for u, a in turns]]})

    return step


def histories(messages: DataFrame, n: int = 20) -> DataFrame:
    """A stream of (conv_id, turn, role, text) as the last n turns of each
    conversation, updated as messages arrive. State is bounded by n."""
    return messages.groupBy("conv_id").applyInPandasWithState(_keep_last(n), "conv_id long, turns array<struct<user:string,assistant:string>>", "turns array<array<string>>, waiting string", "update", GroupStateTimeout.NoTimeout)
