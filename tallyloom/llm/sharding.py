"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, typed


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0 to n-1 of each unsigned 64-bit key; growing n by one moves keys into the new bucket only."""
    key = keys.astype(np.uint64)
    bucket, step = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = step[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step[live] = ((bucket[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[step[live] < n]
    return bucket.astype(np.int32)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row's shard from doc_id and the shard count alone, and a gapless slot inside the shard.

    Null text has size 1 and the CRC of no bytes; a null doc_id hashes as key 0; rows that repeat a doc_id share its
    shard and get slots of their own; an empty table gives no rows. Slots number each (input partition, shard) group by
    itself and add the counts of the partitions before it, so no shard is ever gathered in one task.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def place(ids: pd.Series) -> pd.DataFrame:
        keys = ids.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + 1)})

    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = (
        typed(docs, doc_id="long", text="string")
        .select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
        .withColumn("at", place(F.coalesce("doc_id", F.lit(0).cast("long"))))  # a null would turn the batch to doubles
        .select("doc_id", "size", "text_crc32", "at.shard", "at.grown_shard", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    )
    rows = Scratch(docs.sparkSession, "sharding").save(rows, "rows")  # part and row must not change when a task runs again
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part", "shard").agg(F.count("*").alias("n")).select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row"))
    return rows.withColumn("inside", inside).join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard"
    )
