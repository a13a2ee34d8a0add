"""Average causal effects by linear regression on treatments and adjustment columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.sampling import hash_uniform
from evidentia.operators.graph import backdoor_set

PAIRS_IN_ONE_AGGREGATE = 300


@dataclass
class Moments:
    """Means and population covariances of columns."""

    cols: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def solve(self, regressors: Sequence[str], outcome: str) -> tuple[np.ndarray, float]:
        """Least-squares coefficients and the intercept; the smallest solution if columns depend on each other.

        Columns are brought to deviation 1 first, so that one with large numbers costs the others no digits.
        """
        at = [self.cols.index(c) for c in regressors]
        y = self.cols.index(outcome)
        scale = np.sqrt(np.diag(self.cov)[at])
        scale = np.where(scale > 0, scale, 1.0)
        coef = np.linalg.pinv(self.cov[np.ix_(at, at)] / np.outer(scale, scale), hermitian=True) @ (self.cov[at, y] / scale) / scale
        return coef, float(self.mean[y] - coef @ self.mean[at])


def moments(df: DataFrame, cols: Sequence[str], pairs: set[tuple[str, str]] | None = None) -> Moments:
    """Moments over the complete rows. Up to a few hundred pairs are one JVM aggregate; wide tables sum
    centred cross products of Arrow batches instead. Either way the rows are not shuffled."""
    cols = list(dict.fromkeys(cols))
    rows = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols]).dropna()
    d = len(cols)
    wanted = {(i, j) for i in range(d) for j in range(i, d)}
    if pairs is not None:
        wanted = {tuple(sorted((cols.index(a), cols.index(b)))) for a, b in pairs}
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    cov = np.zeros((d, d))
    if len(wanted) <= PAIRS_IN_ONE_AGGREGATE:
        ordered = sorted(wanted)
        row = rows.agg(
            F.count(F.lit(1)).alias("n"), *means, *[F.covar_pop(cols[i], cols[j]).alias(f"c{k}") for k, (i, j) in enumerate(ordered)]
        ).first()
        for k, (i, j) in enumerate(ordered):
            cov[i, j] = cov[j, i] = row[f"c{k}"]
        mean = np.array([row[f"m{i}"] for i in range(d)])
        return Moments(cols, row["n"], mean, cov)
    row = rows.agg(F.count(F.lit(1)).alias("n"), *means).first()
    mean = np.array([row[f"m{i}"] for i in range(d)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            total += x.T @ x
        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    for r in rows.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / row["n"]
    return Moments(cols, row["n"], mean, cov)


def adjustment_columns(edges: DataFrame, treatments: Sequence[str], outcome: str | None = None, unusable: Sequence[str] = ()) -> DataFrame:
    """Rows ``feature``: what to hold fixed, from a causal graph ``(parent, child)`` of columns.

    With an outcome a minimal set that meets the backdoor condition (see ``backdoor_set``); a graph without one raises. Without an outcome
    the treatments' parents, treatments left out.
    """
    if outcome is not None:
        listed = [(r["parent"], r["child"]) for r in edges.select("parent", "child").distinct().collect()]  # an edge per pair of columns
        chosen = backdoor_set(listed, treatments, outcome, unusable)
        if chosen is None:
            raise ValueError(f"no columns separate {list(treatments)} from {outcome}")
        return edges.sparkSession.createDataFrame([(c,) for c in chosen], "feature string")
    return edges.where(F.col("child").isin(*treatments) & ~F.col("parent").isin(*treatments)).select(
        F.col("parent").alias("feature")
    ).distinct()


def direction(effect: Column) -> Column:
    return F.when(effect < 0, F.lit("reduces")).otherwise(F.lit("increases"))


class AverageCausalEffect(Estimator):
    """Effect of each treatment on the outcome, other treatments and adjustment columns held fixed."""

    treatments = Param(Params._dummy(), "treatments", "treatment columns", TypeConverters.toListString)
    outcome = Param(Params._dummy(), "outcome", "outcome column", TypeConverters.toString)
    adjustment = Param(Params._dummy(), "adjustment", "adjustment columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, treatments=None, outcome=None, adjustment=None):
        super().__init__()
        self._setDefault(adjustment=[])
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> AverageCausalEffectModel:
        treatments, outcome, adjustment = (self.getOrDefault(p) for p in ("treatments", "outcome", "adjustment"))
        found = moments(df, [*treatments, *adjustment, outcome])
        coef, _ = found.solve([*treatments, *adjustment], outcome)
        return AverageCausalEffectModel(dict(zip(treatments, map(float, coef))), outcome, adjustment)


@dataclass
class AverageCausalEffectModel:
    effects: dict[str, float]
    outcome: str
    adjustment: list[str]

    @property
    def value(self) -> float:
        """Effect of raising all treatments by one."""
        return sum(self.effects.values())

    def table(self, spark: SparkSession) -> DataFrame:
        """``(treatment, effect, direction)``."""
        rows = spark.createDataFrame(list(self.effects.items()), "treatment string, effect double")
        return rows.withColumn("direction", direction(F.col("effect")))

    def placebo(self, df: DataFrame, key: Sequence[str], runs: int = 10, seed: int = 0) -> DataFrame:
        """Effects of random treatments: ``(run, effect)``; all should be near zero.

        Every run is one more column of the same aggregate, so the rows are read once and never
        multiplied.
        """
        names = [f"__placebo{r}" for r in range(runs)]
        noise = {n: hash_uniform(*[F.col(c) for c in key], f"run{r}", seed) for r, n in enumerate(names)}
        shared = [*self.adjustment, self.outcome]
        pairs = {(a, b) for a in shared for b in shared} | {(n, c) for n in names for c in [n, *shared]}
        found = moments(df.withColumns(noise), [*names, *shared], pairs)
        rows = [(r, float(found.solve([n, *self.adjustment], self.outcome)[0][0])) for r, n in enumerate(names)]
        return df.sparkSession.createDataFrame(rows, "run int, effect double")
