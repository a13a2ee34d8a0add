"""Probability of each row's values given their parents, by joins with the probability tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.cpt import Network
from evidentia.operators.families import combinations
from evidentia.operators.factors import Term, marginal_terms
from evidentia.operators.graph import ancestors
from evidentia.operators.joins import key_counts, split_join
from evidentia.session import cut_lineage


def fallback_probability(num_classes: int | None) -> float:
    """Used when a value or a parent value is missing or was never seen."""
    return 1.0 / num_classes if num_classes else 0.5


class _Counted:
    """How many rows every key has, counted once on the rows as they came: lookups add columns, no rows."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.known: dict[tuple[str, ...], DataFrame] = {}

    def of(self, keys: Sequence[str]) -> DataFrame | None:
        if self.rows.isStreaming:
            return None
        key = tuple(sorted(keys))
        if key not in self.known:
            self.known[key] = cut_lineage(key_counts(self.rows, key))
        return self.known[key]


def _lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, out: str, counted: _Counted | None = None) -> DataFrame:
    """Left equi-join that adds ``out``. A table of checked size is broadcast; others are joined by exchange, very frequent keys apart."""
    if counted is not None:
        return split_join(df, table.select(*keys, F.col(value).alias(out)), keys, counted.of(keys))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    side = table.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(value).alias(out))
    on: Column | None = None
    for k, n in names.items():
        equal = F.col(k) == F.col(n)
        on = equal if on is None else on & equal
    return df.join(F.broadcast(side), on, "left").drop(*names.values())


def marginal_table(network: Network, node: str, present: Sequence[str]) -> DataFrame:
    """P(node given the present parents), the absent ones summed out of the network. For dense tables.

    Works on the tables of the node and its ancestors: absent variables go one by one, each by
    joining the tables that hold it on their common columns and summing the product.
    """
    shown = [p for p in network.parents[node] if p in present]
    if len(shown) == len(network.parents[node]):
        return network.node_table(node).select(*shown, node, "prob")
    involved = ancestors(node, network.parents) | {node}
    scopes: list[tuple[set[str], DataFrame]] = []
    for c in involved:
        scopes.append(({c, *network.parents[c]}, network.node_table(c).select(*network.parents[c], c, "prob")))
    order = [c for c in reversed(_order(network, involved)) if c not in {node, *shown}]

    def product(group: list[tuple[set[str], DataFrame]]) -> tuple[set[str], DataFrame]:
        scope, out = group[0]
        for other, table in group[1:]:
            right = table.withColumnRenamed("prob", "other")
            out = out.join(right, sorted(scope & other)).withColumn("prob", F.col("prob") * F.col("other")).drop("other")
            scope = scope | other
        return scope, out

    for c in order:
        group = [s for s in scopes if c in s[0]]
        rest = [s for s in scopes if c not in s[0]]
        if not group:
            continue
        scope, out = product(group)
        scope = scope - {c}
        if scope:
            rest.append((scope, out.groupBy(*sorted(scope)).agg(F.sum("prob").alias("prob"))))
        scopes = rest
    # Tables without the node are constant once the present parents are fixed.
    scope, joint = product([s for s in scopes if node in s[0]])
    keys = [p for p in shown if p in scope]
    totals = joint.groupBy(*keys).agg(F.sum("prob").alias("total"))
    if not keys:
        return joint.withColumn("prob", F.col("prob") / totals.select("total").scalar()).select(node, "prob")
    return joint.join(totals, keys).select(*keys, node, (F.col("prob") / F.col("total")).alias("prob"))


def _order(network: Network, involved: set[str]) -> list[str]:
    from evidentia.operators.graph import topological

    return [c for c in topological(network.nodes, network.edges) if c in involved]


def with_probabilities(
    df: DataFrame,
    network: Network,
    nodes: Sequence[str] | None = None,
    num_classes: int | None = None,
    prefix: str = "lambda_",
) -> DataFrame:
    """Append ``lambda_<c>`` = P(c = the row's value given its parents' values) for every node.

    A parent column absent from the table is summed out, an absent node column and any value not
    known give the fallback. Dense tables are broadcast, so the rows are read once and not shuffled.
    """
    fallback = F.lit(fallback_probability(num_classes))
    cols = list(df.columns)
    counted = _Counted(df)
    for node in nodes or network.nodes:
        out = f"{prefix}{node}"
        if node not in cols:
            df = df.withColumn(out, fallback)
            continue
        shown = [p for p in network.parents[node] if p in cols]
        summed = len(shown) < len(network.parents[node])
        above = ancestors(node, network.parents) if summed else set()
        if all(network.is_dense(c) for c in {node, *above}):
            table = marginal_table(network, node, shown)
            keys = [c for c in table.columns if c != "prob"]
            df = _lookup(df, table, keys, "prob", out)
            df = df.withColumn(out, F.coalesce(F.col(out), fallback))
        elif summed:
            df = _sparse_marginal(df, network, node, shown, out, fallback, counted)
        else:
            df = _sparse_lookup(df, network, node, out, fallback, counted)
    return df


def _with_known(df: DataFrame, network: Network, cols: Sequence[str], out: str, counted: _Counted) -> DataFrame:
    """Add whether all of some columns hold states of the network."""
    known, marks = F.lit(True), []
    for c in cols:
        marks.append(f"__known{len(marks)}")
        states = network.node_table(c).select(c).distinct().withColumn("known", F.lit(True))
        df = _lookup(df, states, [c], "known", marks[-1], counted)
        known = known & F.coalesce(F.col(marks[-1]), F.lit(False))
    return df.withColumn(out, known).drop(*marks)


def _value_of(terms: Sequence[Term], names: dict[int, str]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        value = F.lit(t.weight)
        for p in t.parts:
            value = value * F.coalesce(F.col(names[id(p)]), F.lit(0.0))
        total = total + value
    return total


def _sparse_marginal(df: DataFrame, network: Network, node: str, shown: Sequence[str], out: str, fallback: Column, counted: _Counted) -> DataFrame:
    """P(node given the present parents) where some table is too large to lay out: every sparse part is looked up."""
    joint, given = marginal_terms(network, node, shown)
    parts = {id(p): p for t in (*joint, *given) for p in t.parts}
    names = {key: f"__f{i}" for i, key in enumerate(parts)}
    for key, part in parts.items():
        df = _lookup(df, part.table, part.cols, "v", names[key], counted)
    df = _with_known(df, network, [node, *shown], "__known", counted)
    prob = _value_of(joint, names) / _value_of(given, names)
    return df.withColumn(out, F.when(F.col("__known"), prob).otherwise(fallback)).drop("__known", *names.values())


def _sparse_lookup(df: DataFrame, network: Network, node: str, out: str, fallback: Column, counted: _Counted) -> DataFrame:
    """Observed cells by one shuffled join, the others from the parents' totals and the prior."""
    parents = network.parents[node]
    q, r = float(combinations(network.cards, parents)), float(network.cards[node])
    table = network.node_table(node)
    df = _lookup(df, table, [*parents, node], "prob", out, counted)
    # The prior's share of a cell follows from the parent's total; without a total the row is uniform.
    if parents:
        totals = table.groupBy(*parents).agg(F.sum("n").alias("n_pa"))
        df = _lookup(df, totals, parents, "n_pa", "__n_pa", counted)
    else:
        df = df.withColumn("__n_pa", F.lit(None).cast("bigint"))
    unseen = F.lit(network.ess / (r * q)) / (F.coalesce("__n_pa", F.lit(0)) + F.lit(network.ess / q))
    df = _with_known(df, network, [node, *parents], "__known", counted)
    value = F.coalesce(F.col(out), F.when(F.col("__known"), unseen), fallback)
    return df.withColumn(out, value).drop("__n_pa", "__known")
