"""What all selectors share: the fitted selection, its projection and its inverse; and the two
selectors that need no scores of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORT_SCHEMA = "feature string, position int, score double, selected boolean"


class FeatureParams(Params):
    """The feature columns, the label column and columns to carry through a projection."""

    featureCols = Param(Params._dummy(), "featureCols", "feature columns in order", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    keepCols = Param(Params._dummy(), "keepCols", "other columns to keep when projecting", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(keepCols=[])

    def features(self, df: DataFrame) -> list[str]:
        if self.isDefined("featureCols"):
            cols = self.getOrDefault("featureCols")
        else:
            label = self.getOrDefault("labelCol") if self.isDefined("labelCol") else None
            cols = [c for c in df.columns if c != label and c not in self.getOrDefault("keepCols")]
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        return list(cols)

    def label(self, df: DataFrame) -> str:
        if not self.isDefined("labelCol"):
            raise ValueError("a label column is needed to fit")
        if self.getOrDefault("labelCol") not in df.columns:
            raise ValueError(f"label column {self.getOrDefault('labelCol')} is not in the table")
        return self.getOrDefault("labelCol")


class SelectorModel(Model, FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """A fitted selection. ``transform`` keeps the selected columns in input order."""

    selected = Param(Params._dummy(), "selected", "selected features", TypeConverters.toListString)
    scores = Param(Params._dummy(), "scores", "score per feature, NaN if none", TypeConverters.toListFloat)
    featureTypes = Param(Params._dummy(), "featureTypes", "type per feature, double if unknown", TypeConverters.toListString)

    @classmethod
    def of(
        cls, parent: FeatureParams, df: DataFrame, features: Sequence[str], selected: Sequence[str], scores: dict[str, float | None]
    ):
        model = cls()
        chosen = [c for c in features if c in set(selected)]
        values = [float("nan") if scores.get(c) is None else float(scores[c]) for c in features]
        types = dict(df.dtypes)
        model._set(
            featureCols=list(features), selected=chosen, scores=values, keepCols=parent.getOrDefault("keepCols"),
            featureTypes=[types[c] for c in features],
        )
        return model

    def get_support(self) -> list[bool]:
        chosen = set(self.getOrDefault("selected"))
        return [c in chosen for c in self.getOrDefault("featureCols")]

    def get_feature_names_out(self) -> list[str]:
        return list(self.getOrDefault("selected"))

    def support(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, i, None if s != s else s, on)
            for i, (c, s, on) in enumerate(zip(self.getOrDefault("featureCols"), self.getOrDefault("scores"), self.get_support()))
        ]
        return spark.createDataFrame(rows, SUPPORT_SCHEMA)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.getOrDefault("keepCols"), *self.getOrDefault("selected"))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """All original features again, in their types; the dropped ones are zero."""
        chosen = set(self.getOrDefault("selected"))
        types = dict(zip(self.getOrDefault("featureCols"), self.getOrDefault("featureTypes")))
        return df.select(
            *self.getOrDefault("keepCols"),
            *[F.col(c) if c in chosen else F.lit(0).cast(types[c]).alias(c) for c in self.getOrDefault("featureCols")],
        )


class FirstKSelector(Estimator, FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """Keeps the first ``k`` features (default 2), whatever the data."""

    k = Param(Params._dummy(), "k", "how many features to keep", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureCols=None, keepCols=None, k=2):
        super().__init__()
        self._setDefault(k=2)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SelectorModel:
        cols = self.features(df)
        return SelectorModel.of(self, df, cols, cols[: self.getOrDefault("k")], {})


def markov_blanket(edges: DataFrame, node: str) -> DataFrame:
    """Parents, children and the children's other parents of a node, from ``(parent, child)`` rows."""
    children = edges.where(F.col("parent") == node).select("child")
    parents = edges.where(F.col("child") == node).select(F.col("parent").alias("feature"))
    spouses = edges.join(F.broadcast(children), "child").where(F.col("parent") != node).select(F.col("parent").alias("feature"))
    return parents.union(children.select(F.col("child").alias("feature"))).union(spouses).distinct()


class MarkovBlanketSelector(Estimator, FeatureParams):
    """Keeps the label's Markov blanket: by conditional tests (``method="tests"``, default), or that of a network learned over features and
    label (``"network"``). With tests, a feature's score is its statistic given the rest of the blanket over its limit."""

    method = Param(Params._dummy(), "method", "tests or network", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "level of the tests", TypeConverters.toFloat)
    iterations = Param(Params._dummy(), "iterations", "search iterations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, keepCols=None, iterations=100, seed=0, method="tests", alpha=0.01):
        super().__init__()
        self._setDefault(iterations=100, seed=0, method="tests", alpha=0.01)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SelectorModel:
        from evidentia.operators.blanket import BlanketSearch
        from evidentia.operators.structure import learn_structure

        cols, label = self.features(df), self.label(df)
        if self.getOrDefault("method") not in ("tests", "network"):
            raise ValueError(f"unknown method {self.getOrDefault('method')}")
        if self.getOrDefault("method") == "tests":
            search = BlanketSearch(df, label, cols, self.getOrDefault("alpha"))
            chosen = search.find()
            last = {(t.feature, frozenset(t.given)): t.ratio for t in search.tests}
            ratios = {c: last.get((c, frozenset(chosen) - {c})) for c in cols}
            return SelectorModel.of(self, df, cols, chosen, ratios)
        found = learn_structure(
            df, [*cols, label], iterations=self.getOrDefault("iterations"), seed=self.getOrDefault("seed")
        )
        edges = df.sparkSession.createDataFrame(found.edges, "parent string, child string")
        chosen = [r["feature"] for r in markov_blanket(edges, label).collect()]
        return SelectorModel.of(self, df, cols, chosen, {})
