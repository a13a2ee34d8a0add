"""Outliers in event sequences: a two-slice network of an entity's states given its states before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.quantiles import weighted_quantile
from evidentia.operators.cpt import Network, fit_network
from evidentia.operators.families import PARENT_PENALTY, cardinalities, compress
from evidentia.operators.graph import Edge
from evidentia.operators.inference import with_probabilities
from evidentia.operators.outliers import outlier_label, refuse
from evidentia.operators.persist import State, TableModel, Tables, named, under
from evidentia.operators.structure import STAGES, _Scores
from evidentia.session import cut_lineage


def previous_values(df: DataFrame, entity: str, order: Sequence[str], values: dict[str, str], mark: str | None = None) -> DataFrame:
    """Add values of the entity's row before, in the order of ``order`` (end it with a unique column), under new names; ``mark`` tells
    whether there is one.

    A plain ``lag`` by entity would sort all rows of a hot entity in one task. Here the rows are
    range-partitioned by entity and order, so every part holds about as many rows whatever the
    entities' sizes, and the window runs by part. Only the first row of a part looks back: to the
    last row of the part before, from a table with one row per part. The parts are kept as a table,
    so that a retried task finds the same ones.
    """
    placed = cut_lineage(df.repartitionByRange(entity, *order).withColumn("__part", F.spark_partition_id()))
    within = W.partitionBy("__part").orderBy(entity, *order)
    here = F.struct(F.col(entity).alias("e"), F.struct(*[F.col(c) for c in values]).alias("v"))
    last_of_part = placed.groupBy("__part").agg(F.max_by(here, F.struct(entity, *order)).alias("last"))
    before = F.lag("last").over(W.orderBy("__part"))  # one row per part
    ends = last_of_part.select("__part", before.alias("__before"))
    rows = placed.withColumn("__lag", F.lag(here).over(within)).join(F.broadcast(ends), "__part", "left")
    previous = F.coalesce("__lag", "__before")
    known = previous["e"].eqNullSafe(F.col(entity)) & previous.isNotNull()
    found = {out: F.when(known, previous["v"][c]) for c, out in values.items()}
    if mark:
        found[mark] = known
    return rows.withColumns(found).drop("__part", "__lag", "__before")


def previous_value(df: DataFrame, entity: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add one value of the entity's row before."""
    return previous_values(df, entity, order, {value: out})


def slice_edges(pairs: DataFrame, before: dict[str, str]) -> list[tuple[Edge, float]]:
    """Which states depend on which states before, ``((state before, state), score of the state's family)``.

    The search is restricted to edges from one slice to the next, so no cycle can arise and every state is searched by itself: the state
    before that raises its score most is added as long as one does. All candidates of a round are counted in one job. ``pairs`` are combinations with
    their number ``n``; ``before`` names the column that holds a state's value before.
    """
    nodes = [*before.values(), *before]
    counts = pairs.select(*nodes, "n").withColumn("entered", F.lit(STAGES - 1)).persist()
    try:
        scores = _Scores(counts, cardinalities(counts, nodes), nodes)
        place = {c: i for i, c in enumerate(nodes)}
        parents: dict[str, tuple[str, ...]] = {c: () for c in before}
        open_ = list(before)
        value = lambda c, p: scores.family(STAGES - 1, (c, p)) - PARENT_PENALTY * len(p)
        while open_:
            options = {c: [tuple(sorted({*parents[c], x}, key=place.__getitem__)) for x in before.values() if x not in parents[c]] for c in open_}
            scores.fetch([(c, p) for c in open_ for p in [parents[c], *options[c]]])
            grown = []
            for c in open_:
                best = max(options[c], key=lambda p: value(c, p), default=None)
                if best is not None and value(c, best) > value(c, parents[c]):
                    parents[c] = best
                    grown.append(c)
            open_ = grown
        return [((p, c), value(c, ps)) for c, ps in parents.items() for p in ps]
    finally:
        counts.unpersist()


class SequenceOutlierDetector(Estimator):
    """Fits P(states given the states before); a row's score is -ln of it, added up over the states. Rows without a row before have no
    score and count as inliers.

    ``stateCol`` is one state that depends on itself before. ``stateCols`` are several; which of them depend on which is searched, or given as
    ``sliceEdges`` (state before, state).
    """

    entityCol = Param(Params._dummy(), "entityCol", "entity column", TypeConverters.toString)
    orderCols = Param(Params._dummy(), "orderCols", "time column, then tie breakers", TypeConverters.toListString)
    stateCol = Param(Params._dummy(), "stateCol", "state column", TypeConverters.toString)
    stateCols = Param(Params._dummy(), "stateCols", "state columns", TypeConverters.toListString)
    contamination = Param(Params._dummy(), "contamination", "share of outliers", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, entityCol=None, orderCols=None, stateCol=None, stateCols=None, sliceEdges=None, contamination=0.05):
        super().__init__()
        self._setDefault(contamination=0.05)
        given = dict(self._input_kwargs)
        self.slice_edges: list[Edge] | None = given.pop("sliceEdges", None)
        self._set(**{n: v for n, v in given.items() if v is not None})

    def _fit(self, df: DataFrame) -> SequenceOutlierModel:
        entity, order = self.getOrDefault("entityCol"), self.getOrDefault("orderCols")
        if self.isDefined("stateCols"):
            states = self.getOrDefault("stateCols")
            before = {c: f"previous_{c}" for c in states}
        else:
            states = [self.getOrDefault("stateCol")]
            before = {states[0]: "previous"}
        refuse(df.select(*dict.fromkeys([entity, *order, *states])), list(before.values()))
        rows = previous_values(df.select(*dict.fromkeys([entity, *order, *states])), entity, order, before, "__met")
        pairs = cut_lineage(compress(rows.where("__met").dropna(subset=[*before.values(), *states]), [*before.values(), *states]))
        if self.slice_edges is not None:
            edges = [(before[a], b) for a, b in self.slice_edges]
        elif self.isDefined("stateCols"):
            edges = [e for e, _ in slice_edges(pairs, before)]
        else:
            edges = [(before[states[0]], states[0])]
        network = fit_network(pairs, [*before.values(), *states], edges, counted=True)
        model = SequenceOutlierModel(entity, order, before, network)
        scored = model.surprise(pairs)
        model.cutoff = weighted_quantile(scored, "score", "n", 1.0 - self.getOrDefault("contamination"))
        return model


class SequenceOutlierModel(TableModel):
    """Adds ``previous`` (of several states ``previous_<state>``), ``score`` and ``prediction``."""

    def __init__(self, entity: str, order: list[str], before: dict[str, str], network: Network) -> None:
        super().__init__()
        self.entity, self.order, self.before, self.network = entity, order, before, network
        self.cutoff = 0.0

    @property
    def edges(self) -> list[Edge]:
        return self.network.edges

    def state(self) -> tuple[State, Tables]:
        network, tables = self.network.state()
        own = {"entity": self.entity, "order": self.order, "before": self.before, "network": network, "cutoff": self.cutoff}
        return own, named("network", tables)

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> SequenceOutlierModel:
        model = cls(state["entity"], state["order"], state["before"], Network.from_state(state["network"], under("network", tables)))
        model.cutoff = state["cutoff"]
        return model

    def surprise(self, rows: DataFrame) -> DataFrame:
        """Add ``score``: -ln of the states' probability given the states before."""
        states = list(self.before)
        scored = with_probabilities(rows, self.network, states, prefix="__p_")
        total = F.lit(0.0)
        for c in states:
            total = total - F.ln(F.col(f"__p_{c}"))
        return scored.withColumn("score", total).drop(*[f"__p_{c}" for c in states])

    def _transform(self, df: DataFrame) -> DataFrame:
        refuse(df, [*self.before.values(), "score", "prediction"])
        rows = previous_values(df, self.entity, self.order, self.before, "__met")
        known = F.col("__met")
        if len(self.before) == 1:
            known = F.col(next(iter(self.before.values()))).isNotNull()
        scored = self.surprise(rows).withColumn("score", F.when(known, F.col("score"))).drop("__met")
        return scored.withColumn("prediction", F.coalesce(outlier_label(F.col("score"), self.cutoff), F.lit(1)))  # nothing speaks against a first event
