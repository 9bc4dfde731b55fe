"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards alone.

The hash walks from bucket to bucket with a generator seeded by the key and needs no ring table; with one more shard a
key either stays or moves to the new shard. Slots number the rows of a shard without gaps. They are counted in salted
buckets and offset by the bucket totals, so no task holds a whole shard.

Edge cases. A null key counts as -1; a null text as empty (checksum 0, size 16). Equal keys share a shard and get
different slots. An empty table gives an empty result. New columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.session import written_table

SHARDS = 40
ROW_BYTES = 16
SLOT_BUCKETS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into 0 .. shards - 1."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.full(len(state), -1, np.int64)
    step = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = step[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        step[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[step[live] < shards]
    return bucket


def _jumps(shards: int):
    @F.pandas_udf("shard int, grown_shard int")
    def jumps(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in keys:
            values = batch.to_numpy()
            yield pd.DataFrame({"shard": jump_hash(values, shards), "grown_shard": jump_hash(values, shards + 1)})

    return jumps


def with_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows with size, text_crc32, law, shard and grown_shard (the shard with one more); no shuffle."""
    known = F.coalesce(F.col(text), F.lit(""))
    at = _jumps(shards)(F.coalesce(F.col(key).cast("long"), F.lit(-1)))
    return (
        docs.withColumns({
            "size": F.octet_length(known).cast("long") + F.lit(ROW_BYTES).cast("long"),
            "text_crc32": F.crc32(F.encode(known, "UTF-8")), "law": F.lit("key"), "_at": at,
        })
        .withColumns({"shard": F.col("_at.shard"), "grown_shard": F.col("_at.grown_shard")})
        .drop("_at")
    )


def with_slots(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that have a shard, numbered inside it from 0 without gaps (column slot)."""
    salt = F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(SLOT_BUCKETS))
    fixed = written_table(placed.drop("slot").withColumn("_bucket", salt), "placed")  # the salt must not change between the passes
    totals = fixed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # SLOT_BUCKETS rows
    offsets = totals.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(key)) - 1
    # At most SLOT_BUCKETS rows per shard: below 2 MB for 40 shards.
    joined = fixed.withColumn("_inside", inside).join(F.broadcast(offsets), ["shard", "_bucket"])
    return joined.withColumn("slot", (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_start", "_inside")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: the key as doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    digest = with_shards(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", shards).drop("text")
    return with_slots(digest).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the documents as parquet in one folder per shard, several files each."""
    with_shards(docs, key, text, shards).drop("size", "text_crc32", "law", "grown_shard").write.partitionBy("shard").parquet(path)
