"""Shards by jump consistent hashing: the key and the number of shards decide, and no table is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, text_or_empty
from evidentia.session import cut_lineage

STEP = 2862933555777941757  # fixed value: multiplier of the published generator


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. With one more shard a key stays or moves into the new one.

    A key walks through the shards at which it would move; the last one below ``shards`` is its own.
    """
    state = keys.astype(np.uint64)
    place, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    while len(walking):
        place[walking] = ahead[walking]
        with np.errstate(over="ignore"):
            state[walking] = state[walking] * np.uint64(STEP) + np.uint64(1)
        draw = (state[walking] >> np.uint64(33)).astype(np.float64) + 1
        ahead[walking] = np.floor((place[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        walking = walking[ahead[walking] < shards]
    return place


def shard_column(key: Column, shards: int) -> Column:
    """Shard of a bigint key; a null key counts as 0."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("bigint"), F.lit(0)))


def shard_rows(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs(doc_id, text)``.

    ``law`` is ``key``. ``size`` is the text's UTF-8 bytes and 16 (a null text is empty); ``slot`` numbers a
    shard's rows from 0 by key, equal keys by text digest and size; ``grown_shard`` is the shard among one
    more. Null keys share the shard of key 0 and come first; repeated rows take a slot each. Other columns are not
    read. Rows are put in order by a range exchange over all of them and numbered part by part, so a shard
    isn't bound to one task.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text_or_empty()).cast("bigint") + 16).alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
    ).withColumns({"shard": shard_column(F.col("doc_id"), shards), "grown_shard": shard_column(F.col("doc_id"), shards + 1)})
    order = ["doc_id", "text_crc32", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        rows.repartitionByRange(parts, "shard", *order, F.rand(7)).withColumn("part", F.spark_partition_id())
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("start"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy(*order)) - 1
    return placed.withColumn("number", number.cast("bigint")).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("number")).alias("slot"), "grown_shard"
    )
