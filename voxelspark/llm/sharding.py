"""Sharding by jump consistent hashing: no ring table, and appending a shard moves rows only into it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, numbered


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of 64-bit keys, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.int64).view(U64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = jump
            k = key[live] * U64(2862933555777941757) + U64(1)
            key[live] = k
            jump = ((out[live] + 1) * (float(1 << 31) / ((k >> U64(33)) + U64(1)).astype(np.float64))).astype(np.int64)
            going = jump < shards
            live, jump = live[going], jump[going]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key as a Column: an Arrow-batched function, no shuffle."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64), shards), dtype="int32")

    return jump(key)


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """Digest row of each input row: key, size, crc32, shard, slot and the shard after one more is appended.

    The law is ``key``: key and shard count alone decide the shard. A null key is a key like any other
    (it hashes to the seed). A null text has no bytes: size 8, crc32 0. Repeated rows share a shard and
    get slots of their own. An empty table gives an empty result. Other columns are not carried.

    Slots come from one order of all rows by shard and key, made in ranges; rows that repeat a key differ by
    where they were read, so neither a shard nor a hot or null key is sorted by one task. A shard's first
    place in the order (one row a shard, broadcast) is its slot 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(F.col(key))
    rows = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(hashed, shards).alias("shard"),
        shard_of(hashed, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_u"),
    )
    order = numbered(rows, "shard", "key", "size", "text_crc32", "_u")
    first = order.groupBy("shard").agg(F.min("_at").alias("_first"))
    return order.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") - F.col("_first")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 24) -> None:
    """Write all columns of the rows into one folder per shard (``shard=<n>``)."""
    rows = df.withColumn("shard", shard_of(F.xxhash64(F.col(key)), shards))
    # salted, so that a shard is written by several tasks and none has to hold it all
    rows.repartition("shard", F.pmod(F.xxhash64(F.lit("file"), F.col(key)), F.lit(8))).write.partitionBy("shard").parquet(path)
