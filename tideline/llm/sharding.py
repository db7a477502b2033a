"""Sharding by a minimax contiguous partition.

Atomic groups are buckets of equal texts: a bucket is the first hex digits of a text's MD5, so equal texts always share
one. Buckets keep their order; their number is a parameter, so the size table that reaches the driver has a fixed bound
(65,536 rows) at any scale. A binary search over the capacity, each time checked greedily, finds the smallest one
that `shards` contiguous runs can keep; the cuts are then laid as evenly as that capacity allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import materialize


def runs_needed(ends: np.ndarray, capacity: int) -> int:
    """How many contiguous runs of at most `capacity` hold all groups, filled greedily. ends: running sums of sizes."""
    runs, filled = 0, 0
    while filled < ends[-1]:
        filled = int(ends[np.searchsorted(ends, filled + capacity, side="right") - 1])
        runs += 1
    return runs


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which `shards` contiguous runs hold all groups."""
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if runs_needed(ends, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """For each group its run, 0 to shards-1; no run is above smallest_capacity().

    Greedy runs of that capacity would leave the last ones empty. So each run ends where an even share of what is left
    is nearest, within the two bounds that keep it feasible: the greedy end, and the earliest end from which the
    remaining runs still hold the rest (greedy from the right).
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes) or not sizes.sum():
        return np.zeros(len(sizes), dtype=np.int64)
    capacity, ends = smallest_capacity(sizes, shards), np.concatenate([[0], np.cumsum(sizes)])
    earliest = [len(sizes)]
    for _ in range(shards):
        earliest.append(int(np.searchsorted(ends, ends[earliest[-1]] - capacity, side="left")))
    run, start = np.zeros(len(sizes), dtype=np.int64), 0
    for k in range(shards):
        left = shards - k
        even = ends[start] + (ends[-1] - ends[start]) / left
        at = int(np.searchsorted(ends, even))
        at -= at > 0 and even - ends[at - 1] < ends[min(at, len(sizes))] - even
        latest = int(np.searchsorted(ends, ends[start] + capacity, side="right")) - 1
        stop = min(max(at, start, earliest[left - 1]), latest)
        run[start:stop] = k
        start = stop
    return run


def shard(docs: DataFrame, shards: int = 40, digits: int = 4, overhead: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts every row in a shard of near equal bytes; equal texts stay together.

    Returns key, size, text_crc32, bucket, shard, slot (gapless from 0 in each shard, in order of bucket and key).
    A null text has no bytes and CRC 0 and is a group of its own; an empty table gives no rows; rows that repeat each
    get a slot; ties of a key are broken by CRC and size. Other columns of `docs` are not read.

    Slots need no global sort: a bucket with many rows is dealt into salted parts, each counted, so that a slot is
    the part's offset plus a rank among some dozens of rows. The table of parts has at most 16**digits * 1.25 rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(key).alias("k"),
        (F.octet_length(whole) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.when(F.col(text).isNull(), F.lit("\x00null")).otherwise(whole).cast("binary")), 1, digits), 16, 10).cast("int").alias("bucket"),
    )
    thin = materialize(thin, "shard-sizes")
    sizes = thin.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("bucket").toArrow().to_pandas()
    spark, n = docs.sparkSession, int(sizes["n"].sum())
    run = cuts(sizes["bytes"].to_numpy(), shards)
    most = max(64, -(-n // (16**digits // 4)))
    sizes["salts"] = -(-sizes["n"] // most)
    plan = spark.createDataFrame(pa.table({"bucket": sizes["bucket"], "salts": sizes["salts"], "shard": run.astype(np.int32)}))
    salted = thin.join(F.broadcast(plan), "bucket").withColumn("salt", F.pmod(F.xxhash64("k", "text_crc32"), F.col("salts")).cast("int"))
    # A key that repeats very often would fill one salt; its rows are alike, so any further split of them will do.
    parts = salted.groupBy("shard", "bucket", "salt").agg(F.count(F.lit(1)).alias("n")).orderBy("shard", "bucket", "salt").toArrow().to_pandas()
    parts["offset"] = parts.groupby("shard")["n"].cumsum() - parts["n"]
    offsets = spark.createDataFrame(pa.table({x: parts[x] for x in ("bucket", "salt", "offset")}))
    within = Window.partitionBy("bucket", "salt").orderBy("k", "text_crc32", "size")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["bucket", "salt"])
    return ranked.select(F.col("k").alias(key), "size", "text_crc32", "bucket", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
