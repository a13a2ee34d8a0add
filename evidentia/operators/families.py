"""Counts and scores of network families (a node with its parents)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Family = tuple[str, tuple[str, ...]]
FAMILIES_PER_JOB = 200
PARENT_PENALTY = 0.1  # fixed value: taken off a network's score per parent


def compress(df: DataFrame, cols: Sequence[str], *extra: Column) -> DataFrame:
    """One row per observed combination with its count ``n``.

    The map side combines before the shuffle, so the table is as small as the data is regular.
    All families are then counted on it instead of on the rows.
    """
    return df.groupBy(*cols, *extra).agg(F.count(F.lit(1)).alias("n"))


def family_counts(table: DataFrame, families: Sequence[Family], by: Sequence[str] = ()) -> DataFrame:
    """``(family, pa, state, n)`` for many families in one shuffle of a compressed table.

    ``family`` is the position in the list, ``pa`` the parent values as an array. Rows that miss
    any value of a family do not count for it. ``by`` names further grouping columns.
    """
    entries = []
    for i, (node, parents) in enumerate(families):
        pa = F.array(*[F.col(p).cast("string") for p in parents]) if parents else F.array().cast("array<string>")
        complete = F.col(node).isNotNull()
        for p in parents:
            complete = complete & F.col(p).isNotNull()
        entry = F.struct(F.lit(i).alias("family"), pa.alias("pa"), F.col(node).cast("string").alias("state"))
        entries.append(F.when(complete, entry))
    exploded = table.select(F.explode(F.array(*entries)).alias("e"), "n", *by).where("e IS NOT NULL")
    return exploded.groupBy("e.family", *by, "e.pa", "e.state").agg(F.sum("n").alias("n"))


def cardinalities(table: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """How many states each column has, counted in one job."""
    singles = [(c, ()) for c in cols]
    rows = family_counts(table, singles).groupBy("family").count().collect()
    found = {cols[r["family"]]: r["count"] for r in rows}
    return {c: found.get(c, 0) for c in cols}


def combinations(cards: dict[str, int], parents: Iterable[str]) -> int:
    return math.prod(cards[p] for p in parents)


def bic_scores(table: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """``(family, score)`` with score = sum n ln(n / n_pa) - 0.5 ln(N) q (r - 1)."""
    return bic_of_cells(family_counts(table, families), families, cards)


def bic_of_cells(cells: DataFrame, families: Sequence[Family], cards: dict[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Scores from counted families, per value of the ``by`` columns.

    Parent totals are a second grouped sum, so the score is two partial aggregates and no window.
    """
    n = F.col("n")
    strata = cells.groupBy("family", *by, "pa").agg(
        F.sum(n * F.ln(n.cast("double"))).alias("cell_nlogn"), F.sum("n").alias("n")
    )
    cost = F.element_at(
        F.array(*[F.lit(0.5 * combinations(cards, p) * (cards[c] - 1)) for c, p in families]), F.col("family") + 1
    )
    fit = strata.groupBy("family", *by).agg(
        (F.sum("cell_nlogn") - F.sum(n * F.ln(n.cast("double")))).alias("fit"), F.sum("n").alias("total")
    )
    return fit.select("family", *by, (F.col("fit") - F.ln(F.col("total").cast("double")) * cost).alias("score"))


def named_bic_scores(table: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """``(node, parents, score)`` where ``parents`` joins the names with commas."""
    at = F.col("family") + 1
    node = F.element_at(F.array(*[F.lit(c) for c, _ in families]), at)
    parents = F.element_at(F.array(*[F.lit(",".join(p)) for _, p in families]), at)
    return bic_scores(table, families, cards).select(node.alias("node"), parents.alias("parents"), "score")


def network_score(table: DataFrame, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """One row: the sum of the family scores less 0.1 per parent."""
    arcs = sum(len(p) for _, p in families)
    return bic_scores(table, families, cards).agg((F.sum("score") - F.lit(PARENT_PENALTY * arcs)).alias("score"))


def edge_gains(table: DataFrame, nodes: Sequence[str], cards: dict[str, int]) -> DataFrame:
    """How much each single parent adds to a node's BIC score: ``(parent, child, gain)``."""
    pairs = [(c, (p,)) for c in nodes for p in nodes if p != c]
    scores = named_bic_scores(table, [*[(c, ()) for c in nodes], *pairs], cards)
    alone = F.map_from_entries(F.collect_list(F.when(F.col("parents") == "", F.struct("node", "score"))))
    paired = F.collect_list(F.when(F.col("parents") != "", F.struct("parents", "node", "score")))
    # A score per pair of columns: one small row, opened again.
    one = scores.agg(alone.alias("alone"), paired.alias("paired")).select(F.explode("paired").alias("e"), "alone")
    return one.select(
        F.col("e.parents").alias("parent"), F.col("e.node").alias("child"),
        (F.col("e.score") - F.col("alone")[F.col("e.node")]).alias("gain"),
    )


def screened_edges(gains: DataFrame, order: Sequence[str]) -> DataFrame:
    """Edges whose parent comes before the child in ``order`` and raises its score: acyclic by construction."""
    place = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return gains.where((F.col("gain") > 0) & (place[F.col("parent")] < place[F.col("child")])).select("parent", "child")
