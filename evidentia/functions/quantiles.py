"""Exact order statistics and quantiles without gathering the values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.running import running_sums
from evidentia.session import cut_lineage

BUCKETS = 2048
ACCURACY = 10_000


def _clean(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _brackets(
    clean: DataFrame, targets: dict[str, set[int]], counts: dict[str, int], accuracy: int
) -> dict[tuple[str, int], tuple[float, float, int]]:
    """For every (column, rank) an interval of values that holds it, and the rank within the interval.

    A sketch proposes the interval, exact counts confirm it; the whole range serves where they do not.
    """
    wanted = [(c, r) for c in targets for r in sorted(targets[c])]
    slack = 2.0 / accuracy
    aggs = []
    for i, c in enumerate(targets):
        probs = []
        for r in sorted(targets[c]):
            p = (r + 0.5) / counts[c]
            probs += [max(0.0, p - slack), min(1.0, p + slack)]
        aggs += [F.percentile_approx(c, probs, accuracy).alias(f"q{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = clean.agg(*aggs).first()
    ends = {}
    for i, c in enumerate(targets):
        for j, r in enumerate(sorted(targets[c])):
            ends[(c, r)] = (row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1], row[f"lo{i}"], row[f"hi{i}"])
    checks = []
    for i, (c, r) in enumerate(wanted):
        lo, hi, _, _ = ends[(c, r)]
        checks += [F.count_if(F.col(c) < lo).alias(f"b{i}"), F.count_if(F.col(c) <= hi).alias(f"u{i}")]
    seen = clean.agg(*checks).first()
    out = {}
    for i, key in enumerate(wanted):
        lo, hi, least, most = ends[key]
        inside = seen[f"b{i}"] <= key[1] < seen[f"u{i}"]
        out[key] = (lo, hi, key[1] - seen[f"b{i}"]) if inside else (least, most, key[1])
    return out


def order_statistics(
    df: DataFrame, targets: dict[str, set[int]], counts: dict[str, int], buckets: int = BUCKETS, accuracy: int = ACCURACY
) -> dict[tuple[str, int], float]:
    """Values at the given 0-based ranks of each column (nulls and NaN left out).

    Every round counts all open intervals of all columns in one map-side combined aggregate of at
    most ``buckets`` rows per interval, and keeps the one bucket that holds the rank. Intervals
    shrink to observed values, so a handful of scans is enough.
    """
    clean = df.select(*[_clean(c).alias(c) for c in targets])
    open_ = _brackets(clean, targets, counts, accuracy)
    found: dict[tuple[str, int], float] = {}
    while open_:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            break
        intervals = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        entries, inside = [], []
        for j, (c, lo, hi) in enumerate(intervals):
            x = F.col(c)
            position = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(buckets)))
            bucket = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), position)).cast("int")
            inside.append((x >= lo) & (x <= hi))
            entries.append(F.when(inside[-1], F.struct(F.lit(j).alias("i"), bucket.alias("b"), x.alias("x"))))
        rows = (
            clean.where(reduce(lambda a, b: a | b, inside))
            .select(F.explode(F.array(*entries)).alias("e"))
            .where("e IS NOT NULL")
            .groupBy("e.i", "e.b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("lo"), F.max("e.x").alias("hi"))
            .collect()
        )
        counted: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["i"], r["b"])):
            counted.setdefault(r["i"], []).append(r)
        for key, (lo, hi, rank) in list(open_.items()):
            for r in counted[intervals.index((key[0], lo, hi))]:
                if rank < r["n"]:
                    open_[key] = (r["lo"], r["hi"], rank)
                    break
                rank -= r["n"]
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], counts: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Linear-interpolated quantiles by ``order_statistics``, at every size; NaN for a column without values."""
    cols = list(cols)
    if counts is None:
        row = df.agg(*[F.count(_clean(c)).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
        counts = {c: row[f"n_{i}"] for i, c in enumerate(cols)}
    targets = {
        c: {r for p in probs for r in (math.floor(p * (counts[c] - 1)), math.ceil(p * (counts[c] - 1)))}
        for c in cols
        if counts[c] > 0
    }
    stats = order_statistics(df, targets, counts) if targets else {}
    out: dict[str, list[float]] = {}
    for c in cols:
        if counts[c] == 0:
            out[c] = [math.nan] * len(probs)
            continue
        values = []
        for p in probs:
            at = p * (counts[c] - 1)
            low, high = stats[(c, math.floor(at))], stats[(c, math.ceil(at))]
            values.append(low + (high - low) * (at - math.floor(at)))
        out[c] = values
    return out


def weighted_quantiles(df: DataFrame, value: str, weight: str, probs: Sequence[float]) -> list[float]:
    """Linear-interpolated quantiles of a column whose rows stand for ``weight`` equal rows each; NaN for an empty table.

    Weights are added up by range of values, so no task holds them all. Missing values and weights below one count for nothing.
    """
    legal = df.select(_clean(value).alias("x"), F.col(weight).cast("bigint").alias("w")).where("x IS NOT NULL AND w > 0")
    cells = cut_lineage(running_sums(legal.groupBy("x").agg(F.sum("w").alias("w")), [], ["x"], {"upto": F.col("w")}))
    total = cells.agg(F.max("upto")).first()[0]
    if not total:
        return [math.nan] * len(probs)
    ends = [(p * (total - 1), f) for p in probs for f in (math.floor, math.ceil)]
    found = cells.agg(*[F.min(F.when(F.col("upto") > f(at), F.col("x"))).alias(f"q{i}") for i, (at, f) in enumerate(ends)]).first()
    out = []
    for i in range(len(probs)):
        low, high, at = found[2 * i], found[2 * i + 1], ends[2 * i][0]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def weighted_quantile(df: DataFrame, value: str, weight: str, prob: float) -> float:
    """One of ``weighted_quantiles``."""
    return weighted_quantiles(df, value, weight, [prob])[0]
