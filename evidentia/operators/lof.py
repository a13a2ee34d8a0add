"""Local outlier factor (Breunig et al., 2000), exact over a whole table on any number of columns.

The k-neighbourhood holds every other row within the k-distance, ties included.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.binning import ranges
from evidentia.operators.persist import named, under
from evidentia.operators.tree import PartitionTree
from evidentia.session import cut_lineage

LRD_EPSILON = 1e-10  # fixed value: keeps the density of coinciding rows finite


def _within_kth(pairs: DataFrame, k: int) -> DataFrame:
    """Of ``(id, copies, nb, nb_w, dist)`` the pairs within the distance of the k-th other row; copies count one by one."""
    # rank() <= k is pushed below the shuffle as a group limit: few rows per place move.
    by_distance = W.partitionBy("id").orderBy("dist")
    nearest = pairs.withColumn("rank", F.rank().over(by_distance)).where(F.col("rank") <= k)
    up_to = F.sum("nb_w").over(by_distance.rangeBetween(W.unboundedPreceding, W.currentRow))
    same = F.sum("nb_w").over(W.partitionBy("id", "dist"))
    return nearest.withColumn("before", F.col("copies") + up_to - same).where(F.col("before") < k).select("id", "copies", "nb", "nb_w", "dist")


@dataclass
class PlaceFactors:
    """The exact factors of a whole table and what further rows need to be scored against it.

    Rows at the same place are one weighted place from the start, so copies cost nothing: a place with more than k
    rows has factor 1 and asks no neighbours. ``places`` is ``(id, loc, w)``, ``density`` ``(id, k_dist, lrd)`` and
    ``factors`` ``(id, lof)`` for places of at most k rows. Any number of columns; all tables stay distributed.
    """

    cols: list[str]
    k: int
    tree: PartitionTree
    places: DataFrame
    density: DataFrame
    factors: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], k: int, cell_places: int | None = None) -> PlaceFactors:
        cols = list(cols)
        if not cols:
            raise ValueError("a density needs columns")
        found = ranges(df, cols, allow_missing=False)
        rows = next(iter(found.values()))[2]
        if rows <= k:
            raise ValueError(f"{rows} rows have no {k} neighbours")
        counted = df.groupBy(place(cols).alias("loc")).agg(F.count(F.lit(1)).alias("w"))
        places = cut_lineage(counted.select(F.monotonically_increasing_id().alias("id"), "loc", "w"))
        tree = PartitionTree.build(places, len(cols), cell_places)
        pairs = cut_lineage(_within_kth(tree.neighbours(k), k))
        # A place with more than k rows has its k-distance at 0.
        k_dist = pairs.groupBy("id").agg(F.max("dist").alias("k_dist"), F.max("copies").alias("copies"))
        k_of_nb = k_dist.select(F.col("id").alias("nb"), F.col("k_dist").alias("nb_k"))
        reach = F.greatest("dist", F.coalesce("nb_k", F.lit(0.0)))
        sums = pairs.join(k_of_nb, "nb", "left").groupBy("id").agg(
            F.sum(F.col("nb_w") * reach).alias("far"), F.sum("nb_w").alias("others")
        )
        total = F.col("others") + F.col("copies")
        density = F.lit(1.0) / ((F.col("far") + F.col("copies") * F.col("k_dist")) / total + F.lit(LRD_EPSILON))
        lrd = cut_lineage(sums.join(k_dist, "id").select("id", density.alias("lrd"), "copies", total.alias("total"), "k_dist"))
        lrd_of_nb = lrd.select(F.col("id").alias("nb"), F.col("lrd").alias("nb_lrd"))
        near = pairs.join(lrd_of_nb, "nb", "left").groupBy("id").agg(
            F.sum(F.col("nb_w") * F.coalesce("nb_lrd", F.lit(1.0 / LRD_EPSILON))).alias("dense")
        )
        factor = (F.col("dense") + F.col("copies") * F.col("lrd")) / F.col("total") / F.col("lrd")
        factors = cut_lineage(near.join(lrd, "id").select("id", factor.alias("lof")))
        return cls(cols, k, tree, places, lrd.select("id", "k_dist", "lrd"), factors)

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        tree, tables = self.tree.state()
        own = {"places": self.places, "density": self.density, "factors": self.factors}
        return {"cols": self.cols, "k": self.k, "tree": tree}, {**own, **named("tree", tables)}

    @classmethod
    def from_state(cls, state: dict, tables: dict[str, DataFrame]) -> PlaceFactors:
        tree = PartitionTree.from_state(state["tree"], under("tree", tables))
        return cls(state["cols"], state["k"], tree, tables["places"], tables["density"], tables["factors"])

    def at(self, rows: DataFrame, name: str) -> DataFrame:
        """Add where each row lies; null where a column is missing or not finite."""
        finite = F.forall(place(self.cols), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        return rows.withColumn(name, F.when(finite, place(self.cols)))

    def known(self, name: str) -> DataFrame:
        """``(loc, factor)`` of the fitted places."""
        return self.places.join(self.factors, "id", "left").select("loc", F.coalesce("lof", F.lit(1.0)).alias(name))

    def score(self, df: DataFrame, out: str = "lof", apart: bool = False) -> DataFrame:
        """Append the factor of every row; null where a column is missing or not finite.

        A row at a fitted place has that place's factor, as if it were one of its rows; with ``apart`` it counts as another row there. Any
        other row is measured against the fitted places alone, so rows that are scored together don't change each other.
        """
        loc = f"loc-{uuid.uuid4().hex}"  # a name that no table has
        rows = self.at(df, loc)
        # kept before it is filtered: a condition on a place of many columns would be taken apart by the optimizer
        there = rows.select(F.col(f"`{loc}`").alias("loc")).distinct()
        there = cut_lineage(there.select(F.monotonically_increasing_id().alias("id"), "loc")).where("loc IS NOT NULL")
        known = self.known(out)
        fresh = there if apart else cut_lineage(there.join(known, "loc", "left_anti"))
        scored = known.limit(0) if apart else known
        if not fresh.isEmpty():
            scored = scored.unionByName(self._unseen(fresh).select("loc", F.col("lof").alias(out)))
        return rows.join(scored.withColumnRenamed("loc", loc), loc, "left").drop(loc)

    def _unseen(self, fresh: DataFrame) -> DataFrame:
        """``(loc, lof)`` of new places ``(id, loc)`` among the fitted ones."""
        pairs = cut_lineage(_within_kth(self.tree.nearest(fresh, self.k), self.k))
        facts = self.density.select(F.col("id").alias("nb"), "k_dist", F.col("lrd").alias("nb_lrd"))
        joined = pairs.join(facts, "nb", "left")
        reach = F.greatest("dist", F.coalesce("k_dist", F.lit(0.0)))
        sums = joined.groupBy("id").agg(
            F.sum(F.col("nb_w") * reach).alias("far"), F.sum("nb_w").alias("total"),
            F.sum(F.col("nb_w") * F.coalesce("nb_lrd", F.lit(1.0 / LRD_EPSILON))).alias("dense"),
        )
        lof = F.col("dense") / F.col("total") * (F.col("far") / F.col("total") + F.lit(LRD_EPSILON))
        return fresh.join(sums.select("id", lof.alias("lof")), "id").select("loc", "lof")


def place(cols: Sequence[str]) -> Column:
    """Where a row lies; a negative zero is zero."""
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols])


def exact_lof(df: DataFrame, cols: Sequence[str], k: int, out: str = "lof") -> DataFrame:
    """Append the local outlier factor of every row among all rows, on any number of numeric columns."""
    return PlaceFactors.fit(df, cols, k).score(df, out)


def min_max(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(cols)}


def scaled(c: Column, lo: float, hi: float) -> Column:
    """To 0..1 by the fitted range; rows outside it are clipped, a constant score is 0, a missing one stays missing."""
    if hi == lo:
        return F.when(c.isNotNull(), F.lit(0.0))
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c - F.lit(lo)) / F.lit(hi - lo))))


def bagged_lof(df: DataFrame, bags: Sequence[Sequence[str]], k: int, out: str = "lof_score") -> DataFrame:
    """Mean over column bags of the exact factor scaled to 0..1."""
    names = [f"__lof{i}" for i in range(len(bags))]
    fitted = [PlaceFactors.fit(df, bag, k) for bag in bags]
    for one, name in zip(fitted, names):
        df = cut_lineage(one.score(df, name))
    limits = min_max(df, names)
    total = F.lit(0.0)
    for name in names:
        total = total + scaled(F.col(name), *limits[name])
    return df.withColumn(out, total / len(bags)).drop(*names)
