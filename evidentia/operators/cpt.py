"""Conditional probability tables with a uniform Dirichlet (BDeu) prior.

The long form ``(node, pa, state, n, prob)`` holds every node of a network; ``pa`` are the parent
values in the order of the parent list. A table is *dense* when all ``q * r`` cells of every node
fit the limit: then each parent combination is present and lookups may broadcast it. Otherwise the
observed cells are kept and the rest follows from the formula.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.families import Family, cardinalities, combinations, compress, family_counts
from evidentia.operators.graph import Edge, parents_of, topological
from evidentia.operators.structure import as_families
from evidentia.session import discard, kept_table, passing_shuffles

EQUIVALENT_SAMPLE_SIZE = 5.0  # fixed value of the prior
MAX_CELLS = 1_000_000  # cells of a table that lookups may broadcast
STATES_PER_LIST = 1024


def _place(c: str, lists: int) -> Column:
    """The list that a state belongs to."""
    return F.pmod(F.xxhash64(c), F.lit(lists)).cast("int")


@dataclass
class Network:
    """A fitted discrete network: structure, state counts and the long probability table."""

    nodes: list[str]
    edges: list[Edge]
    types: dict[str, str]
    cards: dict[str, int]
    cpt: DataFrame
    ess: float = EQUIVALENT_SAMPLE_SIZE
    max_cells: int = MAX_CELLS
    parents: dict[str, list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.parents = parents_of(self.nodes, self.edges)

    def cells(self, node: str) -> int:
        return self.cards[node] * combinations(self.cards, self.parents[node])

    def is_dense(self, node: str) -> bool:
        return self.cells(node) <= self.max_cells

    def node_table(self, node: str) -> DataFrame:
        """Rows of one node with typed columns: parents, the node itself, ``n``, ``prob``."""
        cols = [F.col("pa")[i].cast(self.types[p]).alias(p) for i, p in enumerate(self.parents[node])]
        return self.cpt.where(F.col("node") == node).select(
            *cols, F.col("state").cast(self.types[node]).alias(node), "n", "prob"
        )

    def complete_table(self, node: str) -> DataFrame:
        """``node_table`` with every combination of parent and node states, whatever their number.

        Large grids are laid out in blocks: a row per combination of parent states and short list of the node's states, to which the
        block's observed cells are joined. Lists are opened last, so cells are neither joined nor moved, and no task or row holds more than a block.
        """
        table = self.node_table(node)
        parents = self.parents[node]
        if self.is_dense(node) or not parents:  # without parents every state was observed
            return table
        grid = None
        for i, p in enumerate(parents):
            lists, listed = self._lists(p, f"__at{i}", f"__all{i}")
            if grid is None:
                grid = listed
            else:
                grid = grid.withColumn(f"__at{i}", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).join(listed, f"__at{i}")
        for i, p in enumerate(parents):
            grid = grid.withColumn(p, F.explode(f"__all{i}"))
        lists, listed = self._lists(node, "__at", "__all")
        totals = table.groupBy(*parents).agg(F.sum("n").alias("__n_pa"))
        cell = F.struct("n", F.array(node).alias("states"))
        seen = table.groupBy(*parents, _place(node, lists).alias("__at")).agg(F.collect_list(cell).alias("__seen"), F.collect_list(node).alias("__met"))
        blocks = grid.select(*parents).join(totals, parents, "left").withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
        blocks = blocks.join(seen, [*parents, "__at"], "left").join(F.broadcast(listed) if self.cards[node] <= MAX_CELLS else listed, "__at")
        none = lambda states: F.array(F.struct(F.lit(0).cast("bigint").alias("n"), states.alias("states")))
        unmet = F.array_except("__all", "__met")
        alike = F.when(F.col("__met").isNull(), none(F.col("__all"))).otherwise(F.concat(none(unmet), "__seen"))
        q, r = float(combinations(self.cards, parents)), float(self.cards[node])
        n = F.col("__alike.n")
        prob = (n + F.lit(self.ess) / (r * q)) / (F.coalesce("__n_pa", F.lit(0)) + F.lit(self.ess) / q)
        shares = blocks.withColumn("__alike", F.explode(alike)).select(*parents, n.alias("n"), prob.alias("prob"), F.col("__alike.states").alias("__states"))
        return shares.select(*parents, F.explode("__states").alias(node), "n", "prob")

    def _lists(self, c: str, at: str, name: str) -> tuple[int, DataFrame]:
        """How many lists a column's states are dealt to, and the lists by their number."""
        lists = max(1, -(-self.cards[c] // STATES_PER_LIST))
        states = self.cpt.where(F.col("node") == c).select(F.col("state").cast(self.types[c]).alias(c)).distinct()
        return lists, states.groupBy(_place(c, lists).alias(at)).agg(F.collect_list(c).alias(name))

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        """Settings and tables, for a model that holds the network."""
        params = {
            "nodes": self.nodes, "edges": [list(e) for e in self.edges], "types": self.types, "cards": self.cards,
            "ess": self.ess, "max_cells": self.max_cells,
        }
        return params, {"cpt": self.cpt}

    @classmethod
    def from_state(cls, state: dict, tables: dict[str, DataFrame]) -> Network:
        return cls(cpt=tables["cpt"], **{**state, "edges": [tuple(e) for e in state["edges"]]})

    def save(self, path: str) -> None:
        """Probabilities as parquet, parameters as one JSON text row."""
        params = {
            "nodes": self.nodes, "edges": self.edges, "types": self.types, "cards": self.cards,
            "ess": self.ess, "max_cells": self.max_cells,
        }
        spark = self.cpt.sparkSession
        self.cpt.write.mode("overwrite").parquet(f"{path}/cpt")
        spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        params = json.loads(spark.read.text(f"{path}/params").first()["value"])
        params["edges"] = [tuple(e) for e in params["edges"]]
        return cls(cpt=spark.read.parquet(f"{path}/cpt"), **params)


def _states(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with, per column, the sorted array of its states. Only for columns whose count is checked."""
    counts = family_counts(table, [(c, ()) for c in cols])
    arrays = [
        F.sort_array(F.collect_set(F.when(F.col("family") == i, F.col("state")))).alias(c) for i, c in enumerate(cols)
    ]
    return counts.agg(*arrays)


def _grid(states: DataFrame, node: str, parents: Sequence[str]) -> DataFrame:
    """Every combination of parent states with every state of the node."""
    out = states.select(*[F.col(c).alias(f"{c}__all") for c in (*parents, node)])
    for c in (*parents, node):
        out = out.withColumn(c, F.explode(f"{c}__all"))
    pa = F.array(*[F.col(p) for p in parents]) if parents else F.array().cast("array<string>")
    return out.select(F.lit(node).alias("node"), pa.alias("pa"), F.col(node).alias("state"))


def fit_network(
    df: DataFrame,
    nodes: Sequence[str],
    edges: Iterable[Edge],
    ess: float = EQUIVALENT_SAMPLE_SIZE,
    max_cells: int = MAX_CELLS,
    counted: bool = False,
) -> Network:
    """Estimate every table of a network: prob = (n + ess/(r q)) / (n_pa + ess/q).

    Two passes over counts: the rows are compressed once, all families are counted in one shuffle.
    The result is kept in the checkpoint folder so that scoring never counts again. ``counted`` rows are combinations with their number ``n``.
    """
    nodes, edges = list(nodes), list(edges)
    topological(nodes, edges)
    types = {c: df.schema[c].dataType.simpleString() for c in nodes}
    for c in nodes:
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"column {c} is not a category")
    families = as_families(nodes, edges)
    spark = df.sparkSession
    table, path = kept_table(df.groupBy(*nodes).agg(F.sum("n").alias("n")) if counted else compress(df, nodes))
    try:
        with passing_shuffles(spark):
            cards = cardinalities(table, nodes)
        dense = [f for f in families if cards[f[0]] * combinations(cards, f[1]) <= max_cells and cards[f[0]]]
        parts = [_dense_cells(table, dense, cards, ess)] if dense else []
        parts += [_sparse_cells(table, f, cards, ess) for f in families if f not in dense]
        return Network(nodes, edges, types, cards, kept_table(reduce(DataFrame.unionByName, parts))[0], ess, max_cells)
    finally:
        discard(spark, path)


def _dense_cells(table: DataFrame, families: Sequence[Family], cards: dict[str, int], ess: float) -> DataFrame:
    """Every cell of tables whose size is checked, all counted together."""
    node_at = F.element_at(F.array(*[F.lit(c) for c, _ in families]), F.col("family") + 1)
    observed = family_counts(table, families).select(node_at.alias("node"), "pa", "state", "n")
    states = _states(table, sorted({c for f in families for c in (f[0], *f[1])}))
    grid = reduce(DataFrame.unionByName, [_grid(states, node, parents) for node, parents in families])
    cells = grid.join(observed, ["node", "pa", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    totals = observed.groupBy("node", "pa").agg(F.sum("n").alias("n_pa"))
    q = F.lit(1.0)
    r = F.lit(1.0)
    for node, parents in families:
        q = F.when(F.col("node") == node, F.lit(float(combinations(cards, parents)))).otherwise(q)
        r = F.when(F.col("node") == node, F.lit(float(cards[node]))).otherwise(r)
    prob = (F.col("n") + F.lit(ess) / (r * q)) / (F.coalesce("n_pa", F.lit(0)) + F.lit(ess) / q)
    return cells.join(totals, ["node", "pa"], "left").select("node", "pa", "state", "n", prob.alias("prob"))


def _sparse_cells(table: DataFrame, family: Family, cards: dict[str, int], ess: float) -> DataFrame:
    """The observed cells of one table, which may be as many as the rows: keys are counted and joined as they are and become text when they are written."""
    node, parents = family
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in (node, *parents)])
    keys = {c: f"__key{i}" for i, c in enumerate((node, *parents))}
    typed = table.where(whole).select(*[_exact_key(table, c).alias(k) for c, k in keys.items()], "n")
    above = [keys[p] for p in parents]
    cells = typed.groupBy(*keys.values()).agg(F.sum("n").alias("n"))
    totals = typed.groupBy(*above).agg(F.sum("n").alias("__n_pa"))
    cells = cells.join(totals, above) if above else cells.withColumn("__n_pa", totals.scalar())
    q, r = float(combinations(cards, parents)), float(cards[node])
    prior = (ess / (r * q), ess / q) if r * q else (0.0, 0.0)  # without states there are no cells
    prob = (F.col("n") + F.lit(prior[0])) / (F.col("__n_pa") + F.lit(prior[1]))
    pa = F.array(*[F.col(k).cast("string") for k in above]) if above else F.array().cast("array<string>")
    return cells.select(F.lit(node).alias("node"), pa.alias("pa"), F.col(keys[node]).cast("string").alias("state"), "n", prob.alias("prob"))


def _exact_key(table: DataFrame, c: str) -> Column:
    """A column whose values differ where their texts do; else its text."""
    kind = table.schema[c].dataType
    return F.col(c) if isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType)) else F.col(c).cast("string")
