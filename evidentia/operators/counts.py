"""Contingency tables. All statistics of the library are functions of these grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.binning import (
    DEFAULT_BINS,
    fit_right_closed,
    is_integer,
    is_numeric,
    right_codes,
)
from evidentia.session import cut_lineage


def contingency(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """Counts ``n`` of each observed combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def code_histogram(codes: DataFrame, col: str) -> DataFrame:
    """Observed codes with counts, and how many codes from 0 to the maximum stay empty."""
    hist = contingency(codes.where(F.col(col).isNotNull()), [F.col(col).alias("code")])
    extent = hist.agg((F.max("code") + 1 - F.count(F.lit(1))).cast("bigint").alias("empty_codes"))
    return hist.withColumn("empty_codes", extent.scalar())


def contingency_2d(codes: DataFrame, a: str, b: str) -> DataFrame:
    """Observed cells with counts, and how many cells of the min-to-max rectangle stay empty."""
    cells = contingency(codes.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [F.col(a).alias("x"), F.col(b).alias("y")])
    area = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    extent = cells.agg((area - F.count(F.lit(1))).cast("bigint").alias("empty_cells"))
    return cells.withColumn("empty_cells", extent.scalar())


def enumerate_codes(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column numbered 0.. in sorted order, missing last.

    The distinct values are range-sorted over the partitions and kept in the checkpoint folder;
    a value's number is its place in its partition plus the sizes of the partitions before.
    """
    spark = df.sparkSession
    values = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(values.orderBy(F.col("value").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["part"], before))
        before += row["count"]
    if not offsets:
        return placed.select("value", F.lit(0).cast("bigint").alias("code"), "n")
    start = spark.createDataFrame(offsets, "part bigint, before bigint")  # a row per partition
    return placed.withColumn("part", part).join(F.broadcast(start), "part").select(
        "value", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("bigint").alias("code"), "n"
    )


def category_columns(
    df: DataFrame, cols: Sequence[str], bin_count: int = DEFAULT_BINS, bin_booleans: bool = False
) -> tuple[dict[str, Column], set[str]]:
    """A category key for every column, and the names of those that were binned.

    Floating columns get right-closed bins. Every other value is its own category. Keys are
    ``struct<i bigint, s string>`` so that columns of different types share one shuffle
    without turning numbers into text.
    """
    binned, keys = [], {}
    for c in dict.fromkeys(cols):
        dtype = df.schema[c].dataType
        if is_numeric(dtype) and not is_integer(dtype) and (bin_booleans or not isinstance(dtype, T.BooleanType)):
            binned.append(c)
    none_s = F.lit(None).cast("string")
    for c, code in right_codes(fit_right_closed(df, binned, bin_count)).items():
        keys[c] = F.struct(code.alias("i"), none_s.alias("s"))
    for c in dict.fromkeys(cols):
        if c not in keys:
            keys[c] = plain_key(df, c)
    return keys, set(binned)


def plain_key(df: DataFrame, c: str) -> Column:
    """A value as its own category: ``struct<i bigint, s string>`` with one side filled."""
    whole = is_integer(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)
    i = F.col(c).cast("bigint") if whole else F.lit(None).cast("bigint")
    s = F.lit(None).cast("string") if whole else F.col(c).cast("string")
    return F.struct(i.alias("i"), s.alias("s"))
