"""Sharding by jump consistent hashing: a key and the number of shards decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankcut.llm.linear import map_batches
from rankcut.session import stage

# Fixed value: multiplier of the generator in the published algorithm.
_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key (Lamping and Veach, 2014), all keys at once.

    A key jumps forward until it leaves the range, on average ``ln(shards)`` times; keys that have left are not looked at again.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(state), np.int64)
    live, at = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(live):
        out[live] = at
        state[live] = state[live] * _STEP + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead = ((at + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        stay = ahead < shards
        live, at = live[stay], ahead[stay]
    return out


def shard_documents(documents: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards; one more shard takes rows only into itself.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: ``size`` is the number of UTF-8 bytes plus 1,
    ``slot`` counts the rows of a shard from 0 in the order of key, checksum and size, ``grown_shard`` is the shard with one more.

    A null text has no bytes (size 1, checksum 0), a null key counts as key 0; other keys must be whole numbers. Rows with equal keys share a shard and have slots of
    their own; wholly equal rows go by their place in the input. Other columns, whatever their names, are ignored. An empty table gives an empty result. Slots come from range-sorted slices and one count per slice and
    shard, so no shard is ever gathered in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))

    def place(batch: dict) -> dict:
        keys = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
        return batch | {"shard": pa.array(jump_hash(keys, shards), pa.int32()), "grown_shard": pa.array(jump_hash(keys, shards + 1), pa.int32())}

    placed = map_batches(rows, rows.columns, place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    # Rows that are equal in all else are told apart by their place, so that any number of them is spread over slices.
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    sliced = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = stage(sliced.withColumn("_at", F.monotonically_increasing_id()), "sharded")
    pinned = pinned.withColumn("_slice", F.shiftright("_at", 33))
    parts = pinned.groupBy("shard", "_slice").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_slice")) - F.col("_n")  # one row per slice and shard
    starts = parts.select("shard", "_slice", (before - F.col("_first")).alias("_shift"))
    numbered = pinned.join(F.broadcast(starts), ["shard", "_slice"])  # at most slices + shards rows
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_shift")).alias("slot"), "grown_shard")
