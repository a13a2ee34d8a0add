"""Features from a Bayesian network: the probability of each value given its parents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.cpt import Network, fit_network
from evidentia.operators.graph import Edge
from evidentia.operators.inference import with_probabilities
from evidentia.operators.persist import State, TableModel, Tables, named, under
from evidentia.operators.selection import FeatureParams
from evidentia.operators.structure import learn_structure


def num_classes(df: DataFrame, label: str) -> DataFrame:
    """How many classes the label has; missing is a class. Grouped first, so nothing is gathered."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return classes.agg(F.count(F.lit(1)).alias("classes"))


class NetworkFeatureGenerator(Estimator, FeatureParams):
    """Fits a network on the feature columns, with a known structure or a learned one. The label is
    no node; it only sets the fallback probability."""

    iterations = Param(Params._dummy(), "iterations", "search iterations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, knownStructure=None, blackList=None, iterations=100, seed=0):
        super().__init__()
        self._setDefault(iterations=100, seed=0)
        given = dict(self._input_kwargs)
        self.known_structure: list[Edge] | None = given.pop("knownStructure", None)
        self.black_list: list[Edge] = list(given.pop("blackList", None) or [])
        self._set(**{n: v for n, v in given.items() if v is not None})

    def _fit(self, df: DataFrame) -> NetworkFeatureModel:
        nodes = self.features(df)
        classes = None
        if self.isDefined("labelCol"):
            classes = num_classes(df, self.label(df)).first()["classes"]
        if self.known_structure:
            edges: Iterable[Edge] = self.known_structure
        else:
            edges = learn_structure(
                df, nodes, self.getOrDefault("iterations"), self.getOrDefault("seed"), self.black_list
            ).edges
        return NetworkFeatureModel(fit_network(df, nodes, edges), classes)


class NetworkFeatureModel(TableModel):
    """Appends ``lambda_<column>`` for every network column; works on batch and streaming tables."""

    def __init__(self, network: Network, classes: int | None) -> None:
        super().__init__()
        self.network = network
        self.num_classes = classes

    @property
    def variables(self) -> list[str]:
        return self.network.nodes

    @property
    def edges(self) -> list[Edge]:
        return self.network.edges

    def _transform(self, df: DataFrame) -> DataFrame:
        return with_probabilities(df, self.network, num_classes=self.num_classes)

    def features(self, df: DataFrame) -> DataFrame:
        """Only the generated columns."""
        return self.transform(df).select(*[f"lambda_{c}" for c in self.network.nodes])

    def state(self) -> tuple[State, Tables]:
        network, tables = self.network.state()
        return {"network": network, "num_classes": self.num_classes}, named("network", tables)

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> NetworkFeatureModel:
        return cls(Network.from_state(state["network"], under("network", tables)), state["num_classes"])
