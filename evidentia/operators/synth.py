"""Synthetic rows by ancestral sampling from a fitted network."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.running import numbered
from evidentia.functions.sampling import hash_uniform
from evidentia.operators.cpt import MAX_CELLS, Network, fit_network
from evidentia.operators.families import combinations
from evidentia.operators.graph import Edge, ancestors, topological
from evidentia.operators.joins import split_join
from evidentia.operators.mixture import choose_mixtures, fit_mixtures, single_normals
from evidentia.operators.persist import State, TableModel, Tables, named, under
from evidentia.operators.selection import FeatureParams
from evidentia.operators.structure import learn_structure
from evidentia.session import cut_lineage, discard, kept_table

LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 20  # of the unit interval of a parent combination
PER_BUCKET = 8  # observed states, of a combination
MANY_STATES = 2048  # beyond which a combination has more buckets than the least
CHUNK = 1 << 18  # observed states that a task adds up in order
FEW_COMBINATIONS = 100_000  # whose numbers of buckets are broadcast


def cumulative_table(network: Network, node: str, out: str = "cdf") -> DataFrame:
    """Per parent combination the sorted states with the upper ends of their probability intervals."""
    parents = network.parents[node]
    table = network.node_table(node)
    upper = F.sum("prob").over(W.partitionBy(*parents).orderBy(node).rowsBetween(W.unboundedPreceding, W.currentRow))
    entry = F.struct(F.col(node).alias("state"), F.col("__hi").alias("hi"))
    return table.withColumn("__hi", upper).groupBy(*parents).agg(F.sort_array(F.collect_list(entry)).alias(out))


def _attach(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str], small: bool) -> DataFrame:
    if not keys:
        # One row of parameters for all: read as scalar subqueries, not joined.
        return df.withColumns({v: table.select(F.col(f"`{v}`")).scalar() for v in values})
    side = table.select(*keys, *[F.col(f"`{v}`") for v in values])
    return df.join(F.broadcast(side) if small else side, list(keys), "left")


def draw_category(df: DataFrame, network: Network, node: str, seed: int, id_col: str, drawn: Sequence[str] = ()) -> DataFrame:
    """Add a sampled column given its parents' columns; null where a parent's value is none of the network's. ``drawn`` are columns that the
    network has filled in itself."""
    if not network.is_dense(node):
        return _draw_sparse(df, network, node, seed, id_col, drawn)
    cdf, at = (f"{n}-{uuid.uuid4().hex}" for n in ("cdf", "u"))  # names that no table has
    df = _attach(df, cumulative_table(network, node, cdf), network.parents[node], [cdf], small=True)
    df = df.withColumn(at, hash_uniform(F.col(id_col), node, seed))
    hit = F.get(F.filter(F.col(f"`{cdf}`"), lambda c: F.col(f"`{at}`") < c["hi"]), F.lit(0))["state"]
    # Rounding may leave the last end a hair below one.
    state = F.coalesce(hit, F.element_at(F.col(f"`{cdf}`"), -1)["state"])
    return df.withColumn(node, state).drop(at, cdf)


def ranked_states(network: Network, node: str) -> DataFrame:
    """``(node, rank)``: a node's states, numbered in their order."""
    return cut_lineage(numbered(network.node_table(node).select(node).distinct(), [node], "rank"))


@dataclass
class Segments:
    """The inverse distribution of a node whose table is too large to lay out: its ``rows``, and into how many ``buckets`` the unit interval of a
    parent combination is cut, where that is not ``LEAST_BUCKETS`` (a number for a node without parents)."""

    rows: DataFrame
    buckets: DataFrame | int
    few: bool
    paths: list[str]


def segments(network: Network, node: str, states: DataFrame) -> Segments:
    """The segments of every parent combination that occurred.

    States lie in their order; one that was never seen takes the same small step as all such. So a row stands for an observed state and all unseen
    ones up to the next: ``[lo, end)`` of the unit interval, of which ``[lo, hi)`` is the observed state (``rank``), then come steps of ``step`` from ``base``
    on. A first row without a state leads up to the first. There is a row for every bucket that a segment touches. Cells move once, to their parents: a
    combination with more than ``CHUNK`` of them is cut by rank, and its parts are added up apart.
    """
    parents = network.parents[node]
    spark, r = states.sparkSession, network.cards[node]
    seen = network.node_table(node).where("n > 0").select(*parents, node, "n")
    totals, path = kept_table(seen.groupBy(*parents).agg(F.sum("n").alias("n_pa"), F.count(F.lit(1)).alias("k")))
    more = F.least(F.greatest(F.ceil(F.col("k") / PER_BUCKET), F.lit(LEAST_BUCKETS)), F.lit(MOST_BUCKETS))
    buckets = F.when(F.col("k") > MANY_STATES, more).otherwise(LEAST_BUCKETS).cast("bigint")
    chunks = F.ceil(F.col("k") / CHUNK)
    found = totals.agg(F.max(buckets).alias("buckets"), F.count_if(buckets > LEAST_BUCKETS).alias("many"), F.max(chunks).alias("chunks")).first()
    split = (found["chunks"] or 0) > 1
    cells = seen.join(states, node).withColumnRenamed(node, "state")
    if parents:
        dealt: DataFrame | int = totals.where(buckets > LEAST_BUCKETS).select(*parents, buckets.alias("buckets"))
        facts = totals.where(chunks > 1).select(*parents, chunks.alias("chunks"))  # at most one for every CHUNK cells
        cells = cells.join(F.broadcast(facts), parents, "left") if split else cells.withColumn("chunks", F.lit(1))
    else:
        dealt = int(found["buckets"] or LEAST_BUCKETS)
        cells = cells.withColumn("chunks", F.lit(found["chunks"] or 1))
    chunk = F.floor(F.col("rank") * F.col("chunks") / F.lit(float(r))).cast("int") if split else F.lit(0)
    part = [*parents, "chunk"]
    cells = cells.withColumn("chunk", F.coalesce(chunk, F.lit(0))).drop("chunks")
    inside = W.partitionBy(*part).orderBy("rank")
    run = cells.withColumns({"upto": F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)), "until": F.lead("rank").over(inside)})
    run = run.withColumns({"n_pa": F.sum("n").over(W.partitionBy(*part)), "k": F.count(F.lit(1)).over(W.partitionBy(*part))})
    if split:
        sums = cells.groupBy(*part).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c"), F.min("rank").alias("first"))
        over, whole = W.partitionBy(*parents).orderBy("chunk"), W.partitionBy(*parents)
        others = sums.select(
            *part, F.coalesce(F.sum("s").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
            F.lead("first").over(over).alias("next"), F.sum("s").over(whole).alias("all_n"), F.sum("c").over(whole).alias("all_k"),
        )
        run = run.join(others, part).withColumns({
            "upto": F.col("before") + F.col("upto"), "until": F.coalesce("until", "next"), "n_pa": F.col("all_n"), "k": F.col("all_k"),
        })
    none = F.lit(0).cast("bigint")
    seg = F.struct(F.col("rank"), F.coalesce("until", F.lit(int(r)).cast("bigint")).alias("until"), F.col("upto"), F.col("n"), F.col("state"))
    lead = F.struct(F.lit(-1).cast("bigint").alias("rank"), F.col("rank").alias("until"), none.alias("upto"), none.alias("n"), F.when(F.lit(False), F.col("state")).alias("state"))
    first = F.col("upto") == F.col("n")  # every cell has rows, so no other has none before it
    rows = run.select(*parents, buckets.alias("buckets"), "n_pa", F.explode(F.when(first, F.array(lead, seg)).otherwise(F.array(seg))).alias("s")).select(*parents, "buckets", "n_pa", "s.*")
    i = interval(network, node, F.col)
    whole = rows.withColumns({"lo": i["lo"], "end": i["end"]}).where("lo < end AND lo < 1")
    touched = F.sequence(F.floor(F.col("lo") * F.col("buckets")), F.least(F.floor(F.col("end") * F.col("buckets")), F.col("buckets") - 1))
    met = whole.withColumn("bucket", F.explode(touched)).select(*parents, "bucket", "rank", "until", "n_pa", "upto", "n", "state")
    out, kept = kept_table(met)
    return Segments(out, dealt, found["many"] <= FEW_COMBINATIONS, [path, kept])


def interval(network: Network, node: str, col: Callable[[str], Column]) -> dict[str, Column]:
    """``step``, ``base``, ``lo``, ``hi`` and ``end`` from a segment's counts, which take less room than they."""
    q, r = float(combinations(network.cards, network.parents[node])), float(network.cards[node])
    mass = col("n_pa") + F.lit(network.ess / q)
    step, base, first = F.lit(network.ess / (r * q)) / mass, col("upto") / mass, col("rank") < 0
    return {
        "step": step, "base": base, "lo": F.when(first, F.lit(0.0)).otherwise(col("rank") * step + (col("upto") - col("n")) / mass),
        "hi": F.when(first, F.lit(0.0)).otherwise((col("rank") + 1) * step + base),
        "end": F.when(col("until") < F.lit(int(r)), col("until") * step + base).otherwise(F.lit(2.0)),
    }


def _draw_sparse(df: DataFrame, network: Network, node: str, seed: int, id_col: str, drawn: Sequence[str]) -> DataFrame:
    """Sampling by an interval join without a range join: intervals and draws meet on (parents, bucket) and are compared there.

    A combination's draws spread over its buckets, so a frequent one is no single task; parents that never occurred together draw evenly from all
    states. Draws move once, to their bucket; only those of states that were never seen are joined with the states' names.
    """
    parents, r = network.parents[node], network.cards[node]
    spark, live = df.sparkSession, df.isStreaming
    tag = lambda n: f"{n}-{uuid.uuid4().hex}"  # noqa: E731  names that no table has
    at, count, bucket, rank, state, known = (tag(n) for n in ("u", "buckets", "bucket", "rank", "state", "known"))
    col = lambda c: F.col(f"`{c}`")
    kept = [col(c) for c in df.columns]
    states = ranked_states(network, node)
    parts = segments(network, node, states)
    if parents and drawn and not live and not parts.few:
        df = cut_lineage(df)  # the parents are counted before they are joined, and drawn once
    rows = df.withColumn(at, hash_uniform(F.col(id_col), node, seed))
    marks = []
    for p in parents:
        if p not in drawn:
            marks.append(tag("known"))
            rows = split_join(rows, network.node_table(p).select(p).distinct().withColumn(marks[-1], F.lit(True)), [p])
    if parents:
        dealt = parts.buckets.withColumnRenamed("buckets", count)
        nowhere = dealt.limit(0).select(*parents, F.lit(0).alias("rows"))
        rows = split_join(rows, F.broadcast(dealt), parents, nowhere) if parts.few else split_join(rows, dealt, parents)
    else:
        rows = rows.withColumn(count, F.lit(parts.buckets).cast("bigint"))
    # draws of a combination without intervals meet nothing and spread, too
    rows = rows.select(*kept, *[col(m) for m in marks], col(at), F.floor(col(at) * F.coalesce(col(count), F.lit(LEAST_BUCKETS))).alias(bucket))
    side = {c: tag(c) for c in ("bucket", "rank", "until", "n_pa", "upto", "n", "state", *parents)}
    side_rows = parts.rows.select(*[F.col(c).alias(n) for c, n in side.items()])
    s = lambda c: col(side[c])
    i = interval(network, node, s)
    on = (col(bucket) == s("bucket")) & (i["lo"] <= col(at)) & (col(at) < i["end"])
    for p in parents:
        on = on & (col(p) == s(p))
    met = rows.join(side_rows, on, "left")
    hit = s("state").isNotNull() & (col(at) < i["hi"])
    further = F.greatest(F.least(F.floor((col(at) - i["base"]) / i["step"]), s("until") - 1), s("rank"))
    evenly = F.least(F.floor(col(at) * F.lit(r)), F.lit(r - 1))
    legal = F.lit(True)
    for p in parents:
        legal = legal & col(p).isNotNull()
    for m in marks:
        legal = legal & F.coalesce(col(m), F.lit(False))
    place = F.when(legal & ~F.coalesce(hit, F.lit(False)), F.when(s("rank").isNull(), evenly).otherwise(further)).cast("bigint")
    met = met.select(*kept, F.when(legal & hit, s("state")).alias(state), place.alias(rank))
    nothing = states.limit(0).select(F.col("rank").alias(rank), F.lit(0).alias("rows"))  # ranks are spread evenly
    names = states.select(F.col("rank").alias(rank), F.col(node).alias(known))
    if live:
        return split_join(met, names, [rank], nothing).select(*kept, F.coalesce(col(state), col(known)).alias(node))
    met, _ = kept_table(met)
    discard(spark, *parts.paths)
    named, _ = kept_table(split_join(met.where(col(rank).isNotNull()), names, [rank], nothing).select(*kept, col(known).alias(node)))
    return met.where(col(rank).isNull()).select(*kept, col(state).alias(node)).union(named)


def standard_normal(id_col: str, node: str, seed: int) -> Column:
    """Box-Muller on two repeatable uniforms."""
    u1 = hash_uniform(F.col(id_col), f"{node}#1", seed)
    u2 = hash_uniform(F.col(id_col), f"{node}#2", seed)
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def draw_number(
    df: DataFrame, table: DataFrame, node: str, parents: Sequence[str], seed: int, id_col: str, small: bool, components: int
) -> DataFrame:
    """Add a continuous column: a mixture component, then a normal value."""
    normal = standard_normal(id_col, node, seed)
    if components == 1:
        side = table.select(*parents, F.get("means", F.lit(0)).alias("__mean"), F.get("sds", F.lit(0)).alias("__sd"))
        df = _attach(df, side, parents, ["__mean", "__sd"], small)
        return df.withColumn(node, F.col("__mean") + F.col("__sd") * normal).drop("__mean", "__sd")
    ends = F.transform(
        "weights", lambda w, i: F.aggregate(F.slice("weights", 1, i + 1), F.lit(0.0), lambda a, b: a + b)
    )
    side = table.select(*parents, ends.alias("__ends"), F.col("means").alias("__means"), F.col("sds").alias("__sds"))
    df = _attach(df, side, parents, ["__ends", "__means", "__sds"], small)
    df = df.withColumn("__u", hash_uniform(F.col(id_col), f"{node}#0", seed))
    # The number of ends at or below u is the component's place.
    df = df.withColumn("__c", F.least(F.size(F.filter("__ends", lambda e: e <= F.col("__u"))), F.size("__means") - 1))
    value = F.get("__means", F.col("__c")) + F.get("__sds", F.col("__c")) * normal
    return df.withColumn(node, value).drop("__u", "__c", "__ends", "__means", "__sds")


class SyntheticGenerator(Estimator, FeatureParams):
    """Fits a hybrid network: ``featureCols`` are categories, ``numericParents`` maps each continuous
    column to its category parents. With ``components`` above 1 continuous nodes are Gaussian mixtures."""

    components = Param(Params._dummy(), "components", "mixture components; 0 chooses 1 to 3 by BIC", TypeConverters.toInt)
    iterations = Param(Params._dummy(), "iterations", "search iterations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    maxCells = Param(Params._dummy(), "maxCells", "cells of a table that is laid out and broadcast", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, featureCols=None, knownStructure=None, blackList=None, numericParents=None, components=1, iterations=100, seed=0, maxCells=MAX_CELLS
    ):
        super().__init__()
        self._setDefault(components=1, iterations=100, seed=0, maxCells=MAX_CELLS)
        given = dict(self._input_kwargs)
        self.known_structure: list[Edge] | None = given.pop("knownStructure", None)
        self.black_list: list[Edge] = list(given.pop("blackList", None) or [])
        self.numeric_parents: dict[str, list[str]] = given.pop("numericParents", None) or {}
        self._set(**{n: v for n, v in given.items() if v is not None})

    def _fit(self, df: DataFrame) -> SyntheticModel:
        nodes = self.features(df)
        edges = self.known_structure
        if edges is None:
            edges = learn_structure(df, nodes, self.getOrDefault("iterations"), self.getOrDefault("seed"), self.black_list).edges
        network = fit_network(df, nodes, edges, max_cells=self.getOrDefault("maxCells"))
        count = self.getOrDefault("components")
        mixtures = {}
        for c, parents in self.numeric_parents.items():
            if count == 0:
                table = choose_mixtures(df, c, parents)
            else:
                table = cut_lineage(fit_mixtures(df, c, parents, count)) if count > 1 else single_normals(df, c, parents)
            mixtures[c] = (list(parents), table, table.count(), count)
        return SyntheticModel(network, mixtures)


class SyntheticModel(TableModel):
    SMALL_ROWS = 1_000_000

    def __init__(self, network: Network, mixtures: dict[str, tuple[list[str], DataFrame, int, int]]) -> None:
        super().__init__()
        self.network, self.mixtures = network, mixtures

    def sample(self, num_samples: int, seed: int = 0) -> DataFrame:
        """``num_samples`` rows with an ``id``; made in parallel, the same for any partitioning."""
        spark = self.network.cpt.sparkSession
        return self._transform(spark.range(num_samples), seed)

    def _transform(self, df: DataFrame, seed: int = 0, id_col: str = "id") -> DataFrame:
        """Fill in every network column that ``df`` does not hold; columns it holds are evidence and
        must be roots or have their ancestors given too, or a ``ValueError`` names those that are not."""
        given = set(df.columns)
        above = {c: ancestors(c, self.network.parents) for c in self.network.nodes}
        for c, (parents, *_) in self.mixtures.items():
            above[c] = set(parents).union(*[above[p] for p in parents])
        loose = {c: sorted(up - given) for c, up in above.items() if c in given and up - given}
        if loose:
            raise ValueError(f"evidence needs its ancestors: {loose}")
        drawn: list[str] = []
        for node in topological(self.network.nodes, self.network.edges):
            if node not in given:
                df = draw_category(df, self.network, node, seed, id_col, drawn)
                drawn.append(node)
        for node, (parents, table, rows, components) in self.mixtures.items():
            if node not in given:
                df = draw_number(df, table, node, parents, seed, id_col, rows <= self.SMALL_ROWS, components)
        keep = [c for c in df.columns if c in given]
        return df.select(*keep, *[c for c in [*self.network.nodes, *self.mixtures] if c not in given])

    def state(self) -> tuple[State, Tables]:
        network, tables = self.network.state()
        facts = {c: [parents, rows, components] for c, (parents, _, rows, components) in self.mixtures.items()}
        return {"network": network, "mixtures": facts}, {**named("network", tables), **named("mixture", {c: m[1] for c, m in self.mixtures.items()})}

    @classmethod
    def from_state(cls, state: State, tables: Tables) -> SyntheticModel:
        mixtures = {c: (p, tables[f"mixture/{c}"], n, k) for c, (p, n, k) in state["mixtures"].items()}
        return cls(Network.from_state(state["network"], under("network", tables)), mixtures)
