"""Operator 9: sharding by a two-pass external shuffle.

The first pass scatters the records over buckets that fit in memory: a record's shard is the one of the highest seeded hash
of (doc_id, shard), so that a further shard takes records only into itself and moves none between the others; its bucket in
the shard is another seeded hash. The second pass shuffles each bucket with Fisher-Yates, seeded by the bucket, and writes it.
The numbers of buckets and of tasks follow from the bytes of the table, never from its rows' keys, so that a bucket's and a task's size stay the same
on any input; equal texts, hot sources and long documents spread like any other records.

Null texts count as no bytes and are written as null. Rows of one doc_id (and all rows without one) are in one shard, as the law wants, and spread over
its buckets by their texts; exact repeats are interchangeable and share a bucket. A very long text is as much of its bucket as it is long; equal hashes (ties) go to the
shard of the larger number. An empty table gives no rows. Further columns of the input are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.base import crc32_of, shared_dir, table

SEED = 20_240_917
#: Bytes of text that a bucket holds on average.
BUCKET_BYTES = 16 << 20
SHARDS = 16


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of the highest hash."""
    draws = F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("draw"), F.lit(k).alias("shard")) for k in range(shards)))
    return F.array_max(draws)["shard"]


def _shuffled(key: tuple, rows: pa.Table, seed: int) -> pa.Table:
    """Fisher-Yates over one bucket, from an order that doesn't depend on how the rows came."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    rng = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
    n = rows.num_rows
    order = list(range(n))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()  # picks[i] is uniform over 0 .. i
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    rows = rows.take(pa.array(order, pa.int64()))
    return rows.append_column("place", pa.array(np.arange(n), pa.int64()))


def scatter(df: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Pass one and two of (doc_id, text): rows with shard, bucket and place in the bucket, not yet written."""
    rows = df.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    keyed = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards, seed), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")), F.lit(buckets)).cast("int")})
    keyed = keyed.repartition(shards * buckets, "shard", "bucket")  # a task for each bucket, but for buckets that share a hash
    return keyed.groupBy("shard", "bucket").applyInArrow(lambda key, rows: _shuffled(key, rows, seed), "doc_id long, text string, shard int, bucket int, place long")


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes the shuffled shards of (doc_id, text) to `path` and returns them as read back: doc_id, text, shard, slot."""
    scatter(df, shards, bucket_bytes, seed).write.parquet(path)
    stored = df.sparkSession.read.schema("doc_id long, text string, shard int, bucket int, place long").parquet(path)
    sizes = stored.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # A row a bucket, of a few bytes: 64 a GB. Without the hint Spark may shuffle all texts again before it knows that size.
    return stored.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "text", "shard", (F.col("start") + F.col("place")).alias("slot"))


def op9_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), shared_dir(spark, "op9"))
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )
