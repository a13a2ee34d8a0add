"""Gaussian mixtures of a continuous column per parent combination, fitted for all of them at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.quantiles import weighted_quantiles
from evidentia.session import cut_lineage

SD_FLOOR = 1e-6
BROADCAST_ROWS = 1_000_000
TOLERANCE = 1e-10  # least share by which an iteration has to raise the likelihood


@dataclass
class _Cells:
    """Distinct values with their numbers, ``(parents..., x, w)``: all that fitting needs, made in one pass over the rows."""

    table: DataFrame
    parents: list[str]
    floor: float
    sd: float

    @classmethod
    def of(cls, df: DataFrame, node: str, parents: Sequence[str]) -> _Cells:
        x = F.nanvl(F.col(node).cast("double"), F.lit(None).cast("double"))
        values = df.select(*parents, x.alias("x")).where(F.col("x").isNotNull())
        table = cut_lineage(values.groupBy(*parents, "x").agg(F.count(F.lit(1)).alias("w")))
        mean = table.agg(F.sum(F.col("x") * F.col("w")) / F.sum("w")).first()[0]
        off = F.col("x") - F.lit(mean)
        variance = table.agg(F.sum(off * off * F.col("w")) / F.sum("w")).first()[0] if mean is not None else 0.0
        sd = math.sqrt(variance or 0.0) or 1.0
        return cls(table, list(parents), sd * SD_FLOOR, sd)

    def fit(self, components: int, iterations: int) -> DataFrame:
        """``(parents..., total, weights, means, sds)`` after expectation-maximisation, all parent combinations at once.

        All start from the quantiles of the whole column, so the result is repeatable. Ends when an iteration no longer raises the likelihood of
        all combinations together by ``TOLERANCE`` of it, or after ``iterations``.
        """
        starts = weighted_quantiles(self.table, "x", "w", [(i + 0.5) / components for i in range(components)])
        params = cut_lineage(self.table.groupBy(*self.parents).agg(
            F.sum("w").alias("total"),
            F.array(*[F.lit(1.0 / components)] * components).alias("weights"),
            F.array(*[F.lit(m) for m in starts]).alias("means"),
            F.array(*[F.lit(self.sd)] * components).alias("sds"),
        ))
        before = None
        for _ in range(iterations):
            stepped = self.step(params, components)
            likelihood = stepped.agg(F.sum("likelihood")).first()[0]  # of the parameters that the step started from
            params = stepped.drop("likelihood")
            if before is not None and likelihood - before <= TOLERANCE * abs(likelihood):
                break
            before = likelihood
        return params

    def step(self, params: DataFrame, components: int) -> DataFrame:
        """One iteration, and ``likelihood``: the log-likelihood of every combination under ``params``."""
        side = F.broadcast(params) if params.count() <= BROADCAST_ROWS else params
        return cut_lineage(_step(self.table, side, self.parents, components, F.lit(self.floor)))


def fit_mixtures(df: DataFrame, node: str, parents: Sequence[str], components: int = 2, iterations: int = 10) -> DataFrame:
    """``(parents..., n, weights, means, sds)`` with one array slot per component: a Gaussian mixture per parent combination.

    The rows are read once, into counts of distinct values; every iteration is a grouped aggregate over those.
    """
    return _Cells.of(df, node, parents).fit(components, iterations).withColumnRenamed("total", "n")


def choose_mixtures(df: DataFrame, node: str, parents: Sequence[str], most: int = 3, iterations: int = 20) -> DataFrame:
    """``(parents..., n, components, bic, weights, means, sds)``: for every parent combination the mixture of 1 to ``most`` components with the least
    BIC, -2 ln L + (3 components - 1) ln n; of equal ones the smaller."""
    cells = _Cells.of(df, node, parents)
    found = None
    for k in range(1, most + 1):
        params = cells.fit(k, iterations)
        worth = cells.step(params, k).select(*cells.parents, "likelihood")
        joined = params.join(worth, cells.parents) if cells.parents else params.withColumn("likelihood", F.lit(worth.first()[0] if not worth.isEmpty() else None).cast("double"))
        n = F.col("total").cast("double")
        one = joined.withColumns({"components": F.lit(k), "bic": -2 * F.col("likelihood") + F.lit(3.0 * k - 1) * F.ln(n)})
        found = one if found is None else found.unionByName(one)
    kept = ["total", "components", "bic", "weights", "means", "sds"]
    best = found.groupBy(*cells.parents).agg(F.min_by(F.struct(*kept), F.struct("bic", "components")).alias("b"))
    return cut_lineage(best.where("b IS NOT NULL").select(*cells.parents, *[F.col(f"b.{c}").alias("n" if c == "total" else c) for c in kept]))


def gaussian_table(df: DataFrame, node: str, parents: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of a continuous column per parent combination."""
    x = F.nanvl(F.col(node).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*parents).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def single_normals(df: DataFrame, node: str, parents: Sequence[str]) -> DataFrame:
    """A mixture of one component needs one aggregate."""
    fitted = gaussian_table(df, node, parents).where(F.col("n") > 0)
    return cut_lineage(
        fitted.select(*parents, "n", F.array(F.lit(1.0)).alias("weights"), F.array("mean").alias("means"), F.array("sd").alias("sds"))
    )


def _log_density(c: int) -> Column:
    z = (F.col("x") - F.col("means")[c]) / F.col("sds")[c]
    return F.ln(F.greatest(F.col("weights")[c], F.lit(1e-300))) - F.ln(F.col("sds")[c]) - z * z / 2


def _step(values: DataFrame, params: DataFrame, parents: list[str], components: int, floor: Column) -> DataFrame:
    rows = values.withColumn("__all", F.lit(1)) if not parents else values
    side = params.withColumn("__all", F.lit(1)) if not parents else params
    joined = rows.join(side, parents or "__all")
    logs = [f"l{c}" for c in range(components)]
    joined = joined.withColumns({l: _log_density(c) for c, l in enumerate(logs)})
    peak = F.greatest(*logs) if components > 1 else F.col(logs[0])
    joined = joined.withColumn("peak", peak)
    total = sum((F.exp(F.col(l) - F.col("peak")) for l in logs[1:]), F.exp(F.col(logs[0]) - F.col("peak")))
    joined = joined.withColumn("norm", total)
    w = F.col("w")
    density = F.col("peak") + F.ln("norm") - F.lit(0.5 * math.log(2 * math.pi))
    sums = [F.sum(w).alias("total"), F.sum(w * density).alias("likelihood")]
    for c, l in enumerate(logs):
        r = w * F.exp(F.col(l) - F.col("peak")) / F.col("norm")
        centred = F.col("x") - F.col("means")[c]
        sums += [F.sum(r).alias(f"r{c}"), F.sum(r * centred).alias(f"d{c}"), F.sum(r * centred * centred).alias(f"q{c}")]
        sums.append(F.first(F.col("means")[c]).alias(f"m{c}"))
        sums.append(F.first(F.col("sds")[c]).alias(f"s{c}"))
    agg = joined.groupBy(*parents).agg(*sums)

    def new_mean(c: int) -> Column:
        return F.when(F.col(f"r{c}") > 1e-9, F.col(f"m{c}") + F.col(f"d{c}") / F.col(f"r{c}")).otherwise(F.col(f"m{c}"))

    def new_sd(c: int) -> Column:
        shift = F.col(f"d{c}") / F.col(f"r{c}")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{c}") / F.col(f"r{c}") - shift * shift))
        return F.when(F.col(f"r{c}") > 1e-9, F.greatest(spread, floor)).otherwise(F.col(f"s{c}"))

    return agg.select(
        *parents, "total", "likelihood",
        F.array(*[F.col(f"r{c}") / F.col("total") for c in range(components)]).alias("weights"),
        F.array(*[new_mean(c) for c in range(components)]).alias("means"),
        F.array(*[new_sd(c) for c in range(components)]).alias("sds"),
    )
