"""Sharding by jump consistent hashing: a stable key and the shard count decide, without a table of the ring.

When a shard is appended, each row either stays or moves to the new shard (Lamping and Veach, "A Fast, Minimal Memory,
Consistent Hash Algorithm").
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, by the published algorithm run over the whole array at once."""
    key = keys.astype(np.uint64, copy=True)
    at, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = 2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long column (a stable hash of the key). A null key hashes to one fixed shard."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 50_000) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard (the shard among shards + 1).

    Slots are gapless from 0 in each shard. No shard is ever numbered by one task: rows fall into hash buckets of about
    per_bucket rows, each bucket is numbered alone, and a bucket's offset is the sum of the counts of those before it.
    The counts are a table of (shard, bucket), whose size is rows / per_bucket.

    Null text: 8 bytes, crc32 0. Null ids share one key, so one shard; their slots differ. Repeated rows get a slot each,
    and rows are dealt to buckets by their place, so that copies do not meet in one. Very long texts: only their bytes are
    counted and summed. Empty input: no rows. Other columns, whatever their names, are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("key", F.xxhash64("doc_id"))
    rows = stash(rows.select("doc_id", "size", "text_crc32", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row")), "shards")
    buckets = 1 + rows.count() // (shards * per_bucket)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("row")
    placed = rows.withColumn("nth", F.row_number().over(own).cast("long")).join(offsets, ["shard", "bucket"])
    return placed.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"), "grown_shard")
