"""Outlier detection for tables: density score, network score and their combination."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.quantiles import exact_quantiles
from evidentia.operators.cpt import Network, fit_network
from evidentia.operators.graph import Edge
from evidentia.operators.inference import with_probabilities
from evidentia.operators.mixture import gaussian_table
from evidentia.operators.lof import PlaceFactors, min_max, scaled
from evidentia.operators.persist import State, TableModel, Tables, named, under
from evidentia.operators.selection import FeatureParams
from evidentia.operators.structure import learn_structure
from evidentia.session import cut_lineage


@dataclass
class GaussianNode:
    """A continuous column given discrete parents. The table is broadcast when its size allows."""

    node: str
    parents: list[str]
    table: DataFrame
    rows: int
    overall: tuple[float, float]

    BROADCAST_ROWS = 1_000_000

    @classmethod
    def fit(cls, df: DataFrame, node: str, parents: Sequence[str]) -> GaussianNode:
        whole = gaussian_table(df, node, []).first()
        table = cut_lineage(gaussian_table(df, node, parents)) if parents else None
        rows = table.count() if table is not None else 1
        return cls(node, list(parents), table, rows, (whole["mean"], whole["sd"]))

    def attach(self, df: DataFrame, mean: str, sd: str) -> DataFrame:
        """Add the mean and deviation of the row's parents; those of all rows where unknown."""
        lit_mean, lit_sd = F.lit(self.overall[0]), F.lit(self.overall[1])
        if not self.parents:
            return df.withColumns({mean: lit_mean, sd: lit_sd})
        keys = [f"__g{i}" for i in range(len(self.parents))]
        side = self.table.select(*[F.col(p).alias(g) for p, g in zip(self.parents, keys)], F.col("mean").alias(mean), F.col("sd").alias(sd))
        if self.rows <= self.BROADCAST_ROWS:
            side = F.broadcast(side)
        on = F.lit(True)
        for i, (p, g) in enumerate(zip(self.parents, keys)):
            on = (F.col(p) == F.col(g)) if i == 0 else on & (F.col(p) == F.col(g))
        joined = df.join(side, on, "left").drop(*keys)
        return joined.withColumns({mean: F.coalesce(F.col(mean), lit_mean), sd: F.coalesce(F.col(sd), lit_sd)})


@dataclass
class NetworkScore:
    """How unlikely each row's values are given their parents: -ln P for categories, |z| for numbers."""

    network: Network
    nodes: list[str]
    gaussians: list[GaussianNode]

    def raw(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        distinct = list(dict.fromkeys(self.nodes))
        df = with_probabilities(df, self.network, distinct, prefix="__p_")
        names = []
        for c in distinct:
            names.append(f"__s_{c}")
            df = df.withColumn(names[-1], -F.ln(F.greatest(F.col(f"__p_{c}"), F.lit(1e-300)))).drop(f"__p_{c}")
        for g in self.gaussians:
            names.append(f"__s_{g.node}")
            df = g.attach(df, "__mean", "__sd")
            # A group of equal numbers has no spread of its own: the spread of all rows tells how far off a value is.
            spread = F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(F.lit(g.overall[1] or 1.0))
            number = F.nanvl(F.col(g.node).cast("double"), F.lit(None).cast("double"))
            df = df.withColumn(names[-1], F.abs(number - F.col("__mean")) / spread).drop("__mean", "__sd")
        return df, names

    def weights(self) -> list[int]:
        """How often each raw score counts: a node that was drawn several times counts each time."""
        distinct = list(dict.fromkeys(self.nodes))
        return [self.nodes.count(c) for c in distinct] + [1] * len(self.gaussians)


def combine(lof: Column, bn: Column, weight: float = 0.5) -> Column:
    """The combined score: a weighted mean of the two scaled scores."""
    return F.lit(weight) * lof + F.lit(1.0 - weight) * bn


def random_bags(cols: Sequence[str], size: int, bags: int, seed: int) -> list[list[str]]:
    """Random column subsets, repeatable by the seed."""
    rng, pool = random.Random(seed), sorted(cols)
    return [sorted(rng.sample(pool, min(size, len(pool)))) for _ in range(bags)]


class TabularOutlierDetector(Estimator, FeatureParams):
    """Scores rows by local density on bags of numeric columns and by a network over the columns.

    ``keyCols`` identify a row. ``categoryCols`` are network nodes, ``numericCols`` enter the density
    score and, given ``numericParents``, the network score. The density of a row is its exact factor among
    all rows of ``fit``, averaged over the bags; rows not seen there are measured against them.
    """

    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoryCols = Param(Params._dummy(), "categoryCols", "category columns", TypeConverters.toListString)
    neighbours = Param(Params._dummy(), "neighbours", "k of the density score", TypeConverters.toInt)
    bagSize = Param(Params._dummy(), "bagSize", "columns per bag", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "number of bags and of random nodes", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of outliers", TypeConverters.toFloat)
    weight = Param(Params._dummy(), "weight", "weight of the density score", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, keyCols=None, numericCols=None, categoryCols=None, knownStructure=None, numericParents=None, bags=None,
        nodes=None, neighbours=5, bagSize=2, iterations=5, contamination=0.05, weight=0.5, seed=0,
    ):
        super().__init__()
        self._setDefault(
            neighbours=5, bagSize=2, iterations=5, contamination=0.05, weight=0.5, seed=0,
            numericCols=[], categoryCols=[],
        )
        given = dict(self._input_kwargs)
        self.known_structure: list[Edge] | None = given.pop("knownStructure", None)
        self.numeric_parents: dict[str, list[str]] = given.pop("numericParents", None) or {}
        self.bags: list[list[str]] | None = given.pop("bags", None)
        self.nodes: list[str] | None = given.pop("nodes", None)
        self._set(**{n: v for n, v in given.items() if v is not None})

    def _fit(self, df: DataFrame) -> TabularOutlierModel:
        get = self.getOrDefault
        numeric, categories = get("numericCols"), get("categoryCols")
        density = []
        bags = self.bags or (random_bags(numeric, get("bagSize"), get("iterations"), get("seed")) if numeric else [])
        for bag in bags:
            density.append(PlaceFactors.fit(df, bag, get("neighbours")))
        network_score = None
        if categories:
            edges = self.known_structure
            if edges is None:
                edges = learn_structure(df, categories, seed=get("seed")).edges
            network = fit_network(df, categories, edges)
            nodes = self.nodes
            if nodes is None:
                rng = random.Random(get("seed"))
                nodes = [rng.choice(categories) for _ in range(get("iterations"))]
            gaussians = [GaussianNode.fit(df, c, p) for c, p in self.numeric_parents.items()]
            network_score = NetworkScore(network, list(nodes), gaussians)
        model = TabularOutlierModel(density, network_score, get("weight"))
        model.calibrate(df, get("contamination"))
        return model


class TabularOutlierModel(TableModel):
    """Adds ``lof_score``, ``bn_score``, ``score``; see ``predict`` and ``decision_function``."""

    def __init__(self, density: list[PlaceFactors], network_score: NetworkScore | None, weight: float) -> None:
        super().__init__()
        self.density, self.network_score, self.weight = density, network_score, weight
        self.fitted: dict[str, tuple[float, float]] = {}
        self.cutoff = 0.0

    def state(self) -> tuple[State, Tables]:
        state: State = {"weight": self.weight, "fitted": self.fitted, "cutoff": self.cutoff, "density": [], "network": None}
        tables: Tables = {}
        for i, factors in enumerate(self.density):
            own, held = factors.state()
            state["density"].append(own)
            tables.update(named(f"density{i}", held))
        if self.network_score:
            network, held = self.network_score.network.state()
            gaussians = self.network_score.gaussians
            state["network"] = {"network": network, "nodes": self.network_score.nodes, "gaussians": [[g.node, g.parents, g.rows, g.overall] for g in gaussians]}
            tables.update(named("network", held))
            tables.update(named("gaussian", {g.node: g.table for g in gaussians if g.table is not None}))
        return state, tables

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> TabularOutlierModel:
        density = [PlaceFactors.from_state(own, under(f"density{i}", tables)) for i, own in enumerate(state["density"])]
        score = None
        if state["network"]:
            kept = state["network"]
            gaussians = [GaussianNode(node, parents, tables.get(f"gaussian/{node}"), rows, tuple(overall)) for node, parents, rows, overall in kept["gaussians"]]
            score = NetworkScore(Network.from_state(kept["network"], under("network", tables)), kept["nodes"], gaussians)
        model = cls(density, score, state["weight"])
        model.fitted, model.cutoff = {c: tuple(r) for c, r in state["fitted"].items()}, state["cutoff"]
        return model

    def _raw(self, df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        lof_names, bn_names = [], []
        for i, factors in enumerate(self.density):
            lof_names.append(f"__lof{i}")
            df = factors.score(df, lof_names[-1])
        if self.network_score:
            df, bn_names = self.network_score.raw(df)
        return df, lof_names, bn_names

    def _scored(self, raw: DataFrame, lof_names: list[str], bn_names: list[str]) -> DataFrame:
        def mean(names: list[str], weights: list[int]) -> Column:
            total = F.lit(0.0)
            for n, w in zip(names, weights):
                total = total + scaled(F.col(n), *self.fitted[n]) * F.lit(float(w))
            return total / max(1, sum(weights))

        weight = self.weight if lof_names and bn_names else (1.0 if lof_names else 0.0)
        drawn = self.network_score.weights() if self.network_score else []
        return (
            raw.withColumns({"lof_score": mean(lof_names, [1] * len(lof_names)), "bn_score": mean(bn_names, drawn)})
            .withColumn("score", combine(F.col("lof_score"), F.col("bn_score"), weight))
            .drop(*lof_names, *bn_names)
        )

    def calibrate(self, df: DataFrame, contamination: float) -> None:
        """Ranges of the raw scores and the cutoff, from the training rows."""
        raw, lof_names, bn_names = self._raw(df)
        names = [*lof_names, *bn_names]
        kept = raw.select(*names).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.fitted = min_max(kept, names)
            score = self._scored(kept, lof_names, bn_names)
            self.cutoff = exact_quantiles(score, ["score"], [1.0 - contamination])["score"][0]
        finally:
            kept.unpersist()

    def _transform(self, df: DataFrame) -> DataFrame:
        refuse(df, ["lof_score", "bn_score", "score"])
        return self._scored(*self._raw(df))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: -1 for an outlier, 1 otherwise."""
        refuse(df, ["prediction"])
        return self.transform(df).withColumn("prediction", outlier_label(F.col("score"), self.cutoff))

    def decision_function(self, df: DataFrame) -> DataFrame:
        """Adds ``decision``: the cutoff minus the score, negative for an outlier."""
        refuse(df, ["decision"])
        return self.transform(df).withColumn("decision", F.lit(self.cutoff) - F.col("score"))


def refuse(df: DataFrame, names: Sequence[str]) -> None:
    """Columns that a result adds must not be there already: they would be lost without a word."""
    there = [c for c in df.columns if c.lower() in names]
    if there:
        raise ValueError(f"the table has columns that the result adds: {there}")


def outlier_label(score: Column, cutoff: float) -> Column:
    """-1 above the cutoff, else 1; null where a row has no score."""
    return F.when(score > F.lit(cutoff), F.lit(-1)).when(score.isNotNull(), F.lit(1))
