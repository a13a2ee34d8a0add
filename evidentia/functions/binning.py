"""Equal-width binning as column expressions.

Codes come from arithmetic with a correction at the bin edges, never from an edge array:
a skewed column may ask for tens of millions of bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.quantiles import exact_quantiles

# Fixed values that decide results: floor of the inter-quartile range, least bin count, default bin count.
IQR_FLOOR = 1e-8
MIN_BINS = 2
DEFAULT_BINS = 100


@dataclass(frozen=True)
class BinSpec:
    """Fitted parameters of one column."""

    feature: str
    lo: float
    hi: float
    bins: int
    n: int
    iqr: float | None = None


def as_double(c: str) -> Column:
    """The column as double, NaN turned into null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def left_closed_code(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Code 0..bins-1 of the bin [edge, next edge); the maximum falls in the last bin."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(bins - 1).cast("bigint"))
    step = (hi - lo) / bins
    f = F.floor((x - F.lit(lo)) / F.lit(step))
    f = (
        F.when(x < f * F.lit(step) + F.lit(lo), f - 1)
        .when(x >= (f + 1) * F.lit(step) + F.lit(lo), f + 1)
        .otherwise(f)
    )
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), f)).cast("bigint"))


def right_closed_code(x: Column, lo: float | None, hi: float | None, bins: int) -> Column:
    """Code 0..bins-1 of the bin (edge, next edge]; the minimum falls in bin 0, missing in bins+1."""
    missing = F.lit(bins + 1).cast("bigint")
    if lo is None or hi is None:
        return missing
    if hi == lo:
        return F.when(x.isNotNull(), F.lit((bins + 1) // 2 - 1).cast("bigint")).otherwise(missing)
    step = (hi - lo) / bins
    f = F.ceil((x - F.lit(lo)) / F.lit(step)) - 1
    f = (
        F.when(x <= f * F.lit(step) + F.lit(lo), f - 1)
        .when(x > (f + 1) * F.lit(step) + F.lit(lo), f + 1)
        .otherwise(f)
    )
    code = F.greatest(F.lit(0), F.least(F.lit(bins - 1), f)).cast("bigint")
    return F.when(x.isNotNull(), code).otherwise(missing)


def ranges(df: DataFrame, cols: Sequence[str], allow_missing: bool = True) -> dict[str, tuple[float, float, int]]:
    """Minimum, maximum and count of each numeric column in one pass; rejects infinite values."""
    for c in cols:
        if not is_numeric(df.schema[c].dataType):
            raise ValueError(f"column {c} is not numeric")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = as_double(c)
        aggs += [F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"), F.count(x).alias(f"n_{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        lo, hi, n = row[f"lo_{i}"], row[f"hi_{i}"], row[f"n_{i}"]
        if n and (math.isinf(lo) or math.isinf(hi)):
            raise ValueError(f"column {c} holds infinite values")
        if not allow_missing and (n < row["rows"] or n == 0):
            raise ValueError(f"column {c} holds missing values")
        out[c] = (lo, hi, n)
    return out


def auto_bins(value_range: float, iqr: float, n: int) -> int:
    """Bin count from the inter-quartile range: max(2, ceil(R / (2 IQR n^(1/3)) * log2(n + 1)))."""
    return max(MIN_BINS, math.ceil(value_range / (2 * max(iqr, IQR_FLOOR) * n ** (1 / 3)) * math.log2(n + 1)))


def fit_left_closed(df: DataFrame, cols: Sequence[str], n_bins: int | str = "auto") -> dict[str, BinSpec]:
    """Bin parameters of complete, finite numeric columns."""
    cols = list(dict.fromkeys(cols))
    found = ranges(df, cols, allow_missing=False)
    if n_bins != "auto":
        return {c: BinSpec(c, lo, hi, int(n_bins), n) for c, (lo, hi, n) in found.items()}
    quartiles = exact_quantiles(df, cols, [0.25, 0.75], {c: n for c, (_, _, n) in found.items()})
    specs = {}
    for c, (lo, hi, n) in found.items():
        iqr = quartiles[c][1] - quartiles[c][0]
        specs[c] = BinSpec(c, lo, hi, auto_bins(hi - lo, iqr, n), n, iqr)
    return specs


def fit_right_closed(df: DataFrame, cols: Sequence[str], bins: int = DEFAULT_BINS) -> dict[str, BinSpec]:
    return {c: BinSpec(c, lo, hi, bins, n) for c, (lo, hi, n) in ranges(df, cols).items()} if cols else {}


def left_codes(specs: dict[str, BinSpec]) -> dict[str, Column]:
    return {c: left_closed_code(as_double(c), s.lo, s.hi, s.bins) for c, s in specs.items()}


def right_codes(specs: dict[str, BinSpec]) -> dict[str, Column]:
    return {c: right_closed_code(as_double(c), s.lo, s.hi, s.bins) for c, s in specs.items()}
