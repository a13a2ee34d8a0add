"""Running sums and numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.session import cut_lineage


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, for every group of ``keys``, the sums of ``values`` over its rows up to each one in ``order``, itself included.

    Rows are dealt out by range of (keys, order) and added up part by part, so a group may hold any share of them.
    """
    keys, order, names = list(keys), list(order), list(values)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"__v_{n}": v.cast("bigint") for n, v in values.items()}).repartitionByRange(parts, *keys, *order)
    placed = cut_lineage(dealt.withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    befores = sums.select("__part", *keys, *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in names])
    inside = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = placed.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in names}).join(befores, ["__part", *keys])
    return run.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__r_{n}")).alias(n) for n in names])


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add the place of every row in the whole order, from 0."""
    return running_sums(df, [], order, {out: F.lit(1)}).withColumn(out, F.col(out) - 1)
