"""Entropy as aggregate expressions over grouped counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_log_n(n: Column) -> Column:
    return F.sum(n * F.log2(n.cast("double")))


def entropy_of_counts(n: Column) -> Column:
    """Base-2 entropy of a group whose rows are category counts: log2(N) - sum(n log2 n) / N."""
    return F.greatest(F.lit(0.0), F.log2(F.sum(n).cast("double")) - n_log_n(n) / F.sum(n))
