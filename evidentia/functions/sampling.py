"""Repeatable sampling: a uniform number per row that depends on the row's key and a seed only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MISSING = "\u0000null"  # told apart from every text of a key part


def _text(part: str | int | Column) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_uniform(*parts: str | int | Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5 over the parts joined by ':'.

    Unlike ``rand(seed)`` the value does not depend on partitioning or row order.
    """
    digest = F.md5(F.concat_ws(":", *[F.coalesce(_text(p), F.lit(MISSING)) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def nested_sample(df: DataFrame, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Rows whose hash lies below ``fraction``; a larger fraction contains every smaller one."""
    return df.where(hash_uniform(*[F.col(c) for c in key], seed) < F.lit(float(fraction)))


def hash_split(df: DataFrame, key: Sequence[str], train: float, seed: int) -> tuple[DataFrame, DataFrame]:
    u = hash_uniform(*[F.col(c) for c in key], seed)
    return df.where(u < F.lit(float(train))), df.where(u >= F.lit(float(train)))


def bottom_k(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """A sample of exactly ``k`` rows: those with the smallest hash (top-k plan, no full sort)."""
    u = hash_uniform(*[F.col(c) for c in key], seed)
    return df.orderBy(u, *key).limit(k)
