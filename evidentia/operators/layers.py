"""Importance of a network's units from a table of their responses.

The table has one row per sample, layer and unit with the response block as an array. Each block
becomes one number (its Frobenius norm), each layer is regressed on the one before, and a unit's
importance is the mean absolute change of the last layer's prediction when the unit is set to zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.persist import State, TableModel, Tables
from evidentia.session import cut_lineage


def frobenius(response: Column) -> Column:
    """Root of the sum of squares of an array of numbers."""
    return F.sqrt(F.aggregate(response, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def response_norms(activations: DataFrame, response: str = "response", out: str = "norm") -> DataFrame:
    """Replace the response block, nested or flat, by its norm."""
    dtype, block = activations.schema[response].dataType, F.col(response)
    while isinstance(dtype.elementType, T.ArrayType):
        block, dtype = F.flatten(block), dtype.elementType
    return activations.withColumn(out, frobenius(block)).drop(response)


def layered(norms: DataFrame, layers: Sequence[str], units: Sequence[Sequence[int]], sample: str) -> DataFrame:
    """One row per complete sample with an array of norms per layer, ``l0, l1, ...``, in unit order."""
    arrays = []
    for i, name in enumerate(layers):
        found = F.collect_list(F.when(F.col("layer") == name, F.struct("unit", "norm")))  # one per unit
        arrays.append(F.transform(F.array_sort(found), lambda e: e["norm"]).alias(f"l{i}"))
    complete = F.lit(True)
    for i, us in enumerate(units):
        complete = complete & (F.size(f"l{i}") == len(us))
    return norms.where(F.col("norm").isNotNull()).groupBy(sample).agg(*arrays).where(complete)


class UnitImportance(Estimator):
    """Fits the chain of linear equations between the layers, in their given order."""

    layers = Param(Params._dummy(), "layers", "layer names in order", TypeConverters.toListString)
    sampleCol = Param(Params._dummy(), "sampleCol", "sample column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layers=None, sampleCol="sample_id"):
        super().__init__()
        self._setDefault(sampleCol="sample_id")
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, activations: DataFrame) -> UnitImportanceModel:
        layers, sample = self.getOrDefault("layers"), self.getOrDefault("sampleCol")
        found = activations.select("layer", "unit").distinct().collect()  # one row per unit
        units = [sorted(r["unit"] for r in found if r["layer"] == name) for name in layers]
        if len(layers) < 2 or not all(units):
            raise ValueError("at least two layers with units are needed")
        rows = cut_lineage(layered(response_norms(activations), layers, units, sample).drop(sample))
        means = self._means(rows, units)
        weights, intercepts = [], []
        for (inner, outer), before, after in zip(self._products(rows, units, means), means, means[1:]):
            w = np.linalg.pinv(inner, hermitian=True) @ outer
            weights.append(w)
            intercepts.append(after - before @ w)
        return UnitImportanceModel(layers, units, sample, weights, intercepts)

    @staticmethod
    def _means(rows: DataFrame, units: list[list[int]]) -> list[np.ndarray]:
        everything = F.posexplode(F.concat(*[f"l{i}" for i in range(len(units))])).alias("at", "norm")
        found = rows.select(everything).groupBy("at").agg(F.avg("norm").alias("mean")).collect()  # one row per unit
        flat = np.zeros(sum(map(len, units)))
        for r in found:
            flat[r["at"]] = r["mean"]
        return np.split(flat, np.cumsum([len(us) for us in units])[:-1])

    @staticmethod
    def _products(rows: DataFrame, units: list[list[int]], means: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Centred cross products of every layer with itself and with the next one. Each task sums its
        Arrow batches; only the sums are shuffled."""
        last = len(units) - 1

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            inner = [np.zeros((len(units[i]), len(units[i]))) for i in range(last)]
            outer = [np.zeros((len(units[i]), len(units[i + 1]))) for i in range(last)]
            for batch in batches:
                if not len(batch):
                    continue
                x = [np.stack(batch[f"l{i}"].to_numpy()) - means[i] for i in range(last + 1)]
                for i in range(last):
                    inner[i] += x[i].T @ x[i]
                    outer[i] += x[i].T @ x[i + 1]
            for kind, parts in enumerate((inner, outer)):
                for i, part in enumerate(parts):
                    r, c = np.indices(part.shape)
                    yield pd.DataFrame({"kind": kind, "layer": i, "r": r.ravel(), "c": c.ravel(), "s": part.ravel()})

        out = [(np.zeros((len(units[i]),) * 2), np.zeros((len(units[i]), len(units[i + 1])))) for i in range(last)]
        summed = rows.mapInPandas(sums, "kind int, layer int, r int, c int, s double").groupBy("kind", "layer", "r", "c").agg(F.sum("s").alias("s"))
        for r in summed.collect():  # one row per pair of units in neighbouring layers
            out[r["layer"]][r["kind"]][r["r"], r["c"]] = r["s"]
        return out


class UnitImportanceModel(TableModel):
    def __init__(self, layers, units, sample, weights: list[np.ndarray], intercepts: list[np.ndarray]) -> None:
        super().__init__()
        self.layers, self.units, self.sample, self.weights, self.intercepts = layers, units, sample, weights, intercepts

    def state(self) -> tuple[State, Tables]:
        numbers = {"weights": [w.tolist() for w in self.weights], "intercepts": [b.tolist() for b in self.intercepts]}
        return {"layers": self.layers, "units": self.units, "sample": self.sample, **numbers}, {}

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> UnitImportanceModel:
        weights, intercepts = ([np.array(x, dtype=float) for x in state[n]] for n in ("weights", "intercepts"))
        return cls(state["layers"], state["units"], state["sample"], weights, intercepts)

    def equations(self, df: DataFrame) -> DataFrame:
        """``(layer, unit, source, coefficient)``; ``source`` is a unit of the layer before, null for the intercept."""
        rows = []
        for i, (w, b) in enumerate(zip(self.weights, self.intercepts)):
            for k, unit in enumerate(self.units[i + 1]):
                rows.append((self.layers[i + 1], unit, None, float(b[k])))
                rows += [(self.layers[i + 1], unit, source, float(w[j, k])) for j, source in enumerate(self.units[i])]
        return df.sparkSession.createDataFrame(rows, "layer string, unit int, source int, coefficient double")

    def _transform(self, activations: DataFrame) -> DataFrame:
        """Per sample the layers' norms and ``predicted``: the last layer from the first through the chain."""
        weights, intercepts = self.weights, self.intercepts

        @F.pandas_udf("array<double>")
        def chained(first: pd.Series) -> pd.Series:
            if not len(first):
                return pd.Series([], dtype=object)
            x = np.stack(first.to_numpy())
            for w, b in zip(weights, intercepts):
                x = x @ w + b
            return pd.Series(list(x))

        rows = layered(response_norms(activations), self.layers, self.units, self.sample)
        return rows.withColumn("predicted", chained("l0"))

    def mse(self, activations: DataFrame) -> DataFrame:
        """One row: mean squared error of the chained prediction over samples and last units."""
        actual = F.col(f"l{len(self.layers) - 1}")
        squares = F.zip_with("predicted", actual, lambda p, a: (p - a) * (p - a))
        total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
        return self.transform(activations).agg(F.avg(total / len(self.units[-1])).alias("mse"))

    def importance(self, activations: DataFrame) -> DataFrame:
        """``(layer, unit, importance)`` of every unit before the last layer.

        The chain is linear, so zeroing a unit moves the last prediction by its norm times the path
        weight from the unit to the end: one aggregate of mean norms gives all units.
        """
        path = np.eye(len(self.units[-1]))
        reach = []
        for i in reversed(range(len(self.layers) - 1)):
            path = self.weights[i] @ path
            reach += [(self.layers[i], unit, float(np.abs(path[j]).mean())) for j, unit in enumerate(self.units[i])]
        spark = activations.sparkSession
        factors = F.broadcast(spark.createDataFrame(reach, "layer string, unit int, reach double"))  # a row per unit
        norms = response_norms(activations)
        complete = layered(norms, self.layers, self.units, self.sample).select(self.sample)  # the rows that fit and mse use
        means = norms.join(complete, self.sample, "left_semi").groupBy("layer", "unit").agg(F.avg(F.abs("norm")).alias("mean_norm"))
        return means.join(factors, ["layer", "unit"]).select("layer", "unit", (F.col("mean_norm") * F.col("reach")).alias("importance"))

    def top(self, activations: DataFrame, n: int = 10) -> DataFrame:
        return self.importance(activations).orderBy(F.desc("importance"), "layer", "unit").limit(n)
