"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly over memory-sized buckets by a seeded hash;
one bucket is one partition. Pass two puts a bucket's records into a canonical
order, shuffles them by Fisher-Yates with a generator seeded by the bucket, and
gives each its place in the whole order: bucket after bucket. Shards are equal
cuts of that order, so their row counts differ by at most one (law ``rows``).
A lost executor's buckets are made again with the same result.

Defined cases: null text has size 8 and CRC 0; null doc_ids and repeated rows
are records like any others (equal doc_id and text have one draw, so such rows share
a bucket); an empty table gives no rows. Records travel as one struct, so the names
of their columns can't clash with the operator's. A bucket is held by one task, so a
text may have 2 GB at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20_011
#: Bytes of text that one bucket holds on average; a task holds one bucket. So
#: that very large corpora don't get too many buckets, they may be larger there,
#: up to the second bound.
BUCKET_BYTES, LARGEST_BUCKET = 16 << 20, 512 << 20
LEAST_BUCKETS, MANY_BUCKETS = 48, 20_000


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Returns record (a struct of all columns of ``docs``), size, text_crc32,
    shard, slot. Shard s holds the slots 0, 1, ... of one cut of the order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(F.encode(text, "UTF-8"))).alias("draw"),
    )
    whole = records.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = whole.rows
    held_bytes = whole.bytes or 0
    n = max(LEAST_BUCKETS, min(-(-held_bytes // bucket_bytes), max(MANY_BUCKETS, -(-held_bytes // LARGEST_BUCKET))))
    records = records.withColumn("bucket", F.pmod("draw", F.lit(n)).cast("int"))
    # One row of two numbers per bucket.
    held = np.zeros(n, np.int64)
    for r in records.groupBy("bucket").count().collect():
        held[r["bucket"]] = r["count"]
    base = np.concatenate([[0], np.cumsum(held)[:-1]]).astype(np.int64)
    cuts = np.array([s * total // shards for s in range(shards)], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(base)
    names = ["record", "size", "text_crc32"]
    schema = f"record {records.schema['record'].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long"

    def fisher_yates(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        bucket = pa.Table.from_batches(found)
        keys = bucket.drop_columns(["record"]).append_column("doc_id", pc.struct_field(bucket["record"], "doc_id"))
        order = pc.sort_indices(keys, [(k, "ascending") for k in ("draw", "doc_id", "text_crc32", "size")]).to_numpy().copy()
        b = bucket["bucket"][0].as_py()
        np.random.default_rng([seed, b]).shuffle(order)  # Fisher-Yates
        place = sent.value[b] + np.arange(len(order))
        shard = np.searchsorted(cuts, place, "right") - 1
        shuffled = bucket.select(names).take(pa.array(order))
        shuffled = shuffled.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(place - cuts[shard]))
        yield from shuffled.combine_chunks().to_batches(max_chunksize=2000)

    return records.repartitionById(n, F.col("bucket")).mapInArrow(fisher_yates, schema)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = SEED) -> None:
    """Write the shuffled records, a folder for each shard; ``slot`` is their order."""
    shuffle_into_shards(docs, shards, seed).select("record.*", "slot", "shard").write.partitionBy("shard").parquet(path)
