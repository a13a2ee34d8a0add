"""Reading tables and splitting the target off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Any format Spark reads. A CSV has a header; its types are inferred unless a schema is given."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", options.pop("header", "true"))
        if schema is None:
            reader = reader.option("inferSchema", options.pop("inferSchema", "true"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def as_table(spark: SparkSession, rows, columns: Sequence[str] | str | None = None) -> DataFrame:
    """A DataFrame as it is, or local rows (lists, dicts, arrays, pandas) as one."""
    return rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, columns)


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    return df.drop(target), df.select(target)


def attach_target(df: DataFrame, target: DataFrame, key: Sequence[str] | str, how: str = "exact") -> DataFrame:
    """Feature rows with the target that lives in another table under the same key.

    Every row must have one target and every target one row, or a ``ValueError`` tells what does not fit. With
    ``how="inner"`` rows without a target and targets without a row are left out; keys must still be unique among targets.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if how not in ("exact", "inner"):
        raise ValueError(f"how is 'exact' or 'inner', not {how!r}")
    sides = df.select(*keys, F.lit(1).alias("__rows"), F.lit(0).alias("__targets")).unionByName(
        target.select(*keys, F.lit(0).alias("__rows"), F.lit(1).alias("__targets"))
    )
    counts = sides.groupBy(*keys).agg(F.sum("__rows").alias("rows"), F.sum("__targets").alias("targets"))
    unknown = F.lit(False)
    for k in keys:
        unknown = unknown | F.col(k).isNull()
    found = counts.agg(
        F.count_if(F.col("targets") > 1).alias("repeated"),
        F.count_if((F.col("rows") != F.col("targets")) | unknown).alias("unmatched"),
    ).first()
    if found["repeated"] or (how == "exact" and found["unmatched"]):
        raise ValueError(f"{found['repeated']} keys have several targets, {found['unmatched']} keys don't match")
    return df.join(target, keys, "inner")
