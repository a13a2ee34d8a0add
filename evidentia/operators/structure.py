"""Structure search: stochastic hill climbing over edge lists, scored in Spark.

The rows are compressed once into counts per observed combination. Each round asks Spark for the
statistics of every family that is one legal move away and not known yet, in one job; the
walk itself touches scores only. Samples are nested: of every combination's rows each sample takes its
share, up to one row, and a larger sample keeps what a smaller one has.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations as combos

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.sampling import hash_uniform
from evidentia.operators.families import (
    FAMILIES_PER_JOB,
    PARENT_PENALTY,
    Family,
    cardinalities,
    combinations,
    compress,
)
from evidentia.operators.graph import Edge, is_acyclic, parents_of
from evidentia.session import cut_lineage

# Fixed values of the search.
REPOSITORY_SIZE = 10
FIRST_FRACTION = 0.1
STAGES = 4
ADD_TRIES = 10
TIE = 1e-9  # networks of equal score, such as one with an edge reversed, are no improvement


@dataclass
class Structure:
    nodes: list[str]
    edges: list[Edge]
    score: float
    forest: list[Edge]
    forest_score: float
    jobs: int


@dataclass(frozen=True)
class _Set:
    """Columns whose combinations are counted, among the rows that have a value in ``full`` as well."""

    cols: frozenset[str]
    full: frozenset[str]


class SetCounts:
    """Statistics of sets of columns, fetched from Spark in batches: H = the sum of n ln n over the combinations of a set, and the rows.

    ``table`` holds the counts ``n`` by the stage at which rows enter the sample (``entered``); only the counted cells are added up for the
    stages that contain them, so one job serves all stages. Large tables are not read for every batch: the margin over the columns that
    sets have in common is kept as a table, and a set is counted from the smallest table kept that holds its columns.
    """

    MARGIN_ROWS = 100_000  # a table up to this size needs no smaller margins
    MARGIN_COLUMNS = 8

    def __init__(self, table: DataFrame, cols: Sequence[str]) -> None:
        self.cols = list(cols)
        sizes = table.agg(F.count(F.lit(1)), *[F.count_if(F.col(c).isNull()) for c in cols]).first()
        self.gaps = frozenset(c for c, n in zip(cols, sizes[1:]) if n)  # columns with missing values
        self.margins: list[tuple[frozenset[str], DataFrame, int]] = [(frozenset(cols), table, sizes[0])]
        self.known: dict[_Set, list[tuple[float, int]]] = {}
        self.jobs = 0

    def of(self, cols: Iterable[str], among: Iterable[str] = ()) -> _Set:
        """The set of some columns among the rows that have values in ``among`` as well."""
        cols = frozenset(cols)
        return _Set(cols, (frozenset(among) & self.gaps) - cols)

    def missing(self, sets: Iterable[_Set]) -> list[_Set]:
        return [s for s in dict.fromkeys(sets) if s.cols and s not in self.known]

    def value(self, s: _Set, stage: int, whole: _Set) -> tuple[float, int]:
        """H and the rows of a set; of no columns, those of the rows of ``whole``."""
        if s.cols:
            return self.known[s][stage]
        total = self.known[whole][stage][1]
        return (total * math.log(total) if total else 0.0), total

    def fetch(self, needed: Iterable[_Set], likely: Iterable[_Set] = ()) -> None:
        """Count the needed sets, and as many likely ones as fit the last job."""
        wanted = self.missing(needed)
        if not wanted:
            return
        room = -len(wanted) % FAMILIES_PER_JOB
        if room:
            wanted += [s for s in self.missing([*likely, *_small_sets(self.cols, FAMILIES_PER_JOB)]) if s not in wanted][:room]
        for start in range(0, len(wanted), FAMILIES_PER_JOB):
            self._count(wanted[start : start + FAMILIES_PER_JOB])

    def _count(self, batch: list[_Set]) -> None:
        covers: list[tuple[set[str], list[int]]] = []
        for k in sorted(range(len(batch)), key=lambda k: -len(batch[k].cols | batch[k].full)):
            need = batch[k].cols | batch[k].full
            for cover, members in covers:
                if len(cover | need) <= max(self.MARGIN_COLUMNS, len(need)):
                    cover |= need
                    members.append(k)
                    break
            else:
                covers.append((set(need), [k]))
        cells = None
        for cover, members in covers:
            one = self._cells(self._margin(frozenset(cover)), [(k, batch[k]) for k in members])
            cells = one if cells is None else cells.unionByName(one)
        n = F.col("n")
        rows = cells.groupBy("k", "stage").agg(F.sum(n * F.ln(n.cast("double"))).alias("h"), F.sum("n").alias("total")).collect()
        self.jobs += 1
        for s in batch:
            self.known[s] = [(0.0, 0)] * STAGES
        for r in rows:
            self.known[batch[r["k"]]][r["stage"]] = (r["h"], r["total"])

    def _cells(self, table: DataFrame, numbered: list[tuple[int, _Set]]) -> DataFrame:
        """``(k, stage, at, n)``: the counted combinations of every set. The sets are data, so a plan is the same for one and for hundreds."""
        order = [c for c in self.cols if c in table.columns]
        place = {c: i + 1 for i, c in enumerate(order)}
        listed = [F.struct(F.lit(k).alias("k"), F.lit([place[c] for c in order if c in s.cols]).alias("cols"), F.lit([place[c] for c in order if c in s.cols | s.full]).alias("full")) for k, s in numbered]
        values = F.array(*[F.col(c).cast("string") for c in order])
        rows = table.select(values.alias("v"), "entered", "n", F.explode(F.array(*listed)).alias("s"))
        legal = rows.where(F.forall("s.full", lambda i: F.element_at("v", i).isNotNull()))
        cells = legal.groupBy(F.col("s.k").alias("k"), "entered", F.transform("s.cols", lambda i: F.element_at("v", i)).alias("at")).agg(F.sum("n").alias("n"))
        stages = F.explode(F.sequence("entered", F.lit(STAGES - 1))).alias("stage")
        return cells.select("k", "at", "n", stages).groupBy("k", "stage", "at").agg(F.sum("n").alias("n"))

    def _margin(self, cols: frozenset[str]) -> DataFrame:
        """The smallest table kept that holds some columns, or a new one where that is large."""
        held, table, rows = min((m for m in self.margins if cols <= m[0]), key=lambda m: m[2])
        if rows <= self.MARGIN_ROWS or held == cols:
            return table
        names = [c for c in self.cols if c in cols]
        made = cut_lineage(table.groupBy(*names, "entered").agg(F.sum("n").alias("n")))
        self.margins.append((cols, made, made.count()))
        return made


class _Scores:
    """Family scores at every sample stage: a family's fit is H(node and parents) - H(parents), so families that share columns share statistics."""

    def __init__(self, table: DataFrame, cards: dict[str, int], cols: Sequence[str]) -> None:
        self.cards, self.cols = cards, list(cols)
        self.counts = SetCounts(table, cols)

    @property
    def jobs(self) -> int:
        return self.counts.jobs

    def sets(self, family: Family) -> tuple[_Set, _Set]:
        """The sets of the family and of its parents; rows that miss a value of the family count for neither."""
        whole = {family[0], *family[1]}
        return self.counts.of(whole), self.counts.of(family[1], whole)

    def has(self, families: Iterable[Family]) -> bool:
        return not self.counts.missing(s for f in families for s in self.sets(f))

    def fetch(self, needed: Iterable[Family], likely: Iterable[Family] = ()) -> None:
        """Count what the needed families ask, and as much for likely ones as fits the last job."""
        self.counts.fetch([s for f in needed for s in self.sets(f)], (s for f in likely for s in self.sets(f)))

    def family(self, stage: int, f: Family) -> float:
        """sum n ln(n / n_pa) - 0.5 ln(N) q (r - 1)"""
        whole, parents = self.sets(f)
        h, total = self.counts.value(whole, stage, whole)
        if not total:
            return 0.0
        above, _ = self.counts.value(parents, stage, whole)
        cost = 0.5 * combinations(self.cards, f[1]) * (self.cards[f[0]] - 1)
        return steady(h - above - math.log(total) * cost)

    def network(self, stage: int, edges: Sequence[Edge]) -> float:
        families = as_families(self.cols, edges)
        self.fetch(families)
        return sum(self.family(stage, f) - PARENT_PENALTY * len(f[1]) for f in families)


def steady(score: float) -> float:
    """Ten digits of a score: sums of doubles have no fixed order, and a seed must decide alone."""
    return float(f"{score:.10g}")


def as_families(nodes: Sequence[str], edges: Iterable[Edge]) -> list[Family]:
    return [(c, tuple(p)) for c, p in parents_of(nodes, edges).items()]


def _small_sets(nodes: Sequence[str], most: int) -> list[_Set]:
    """Sets of columns by size, the ones a search meets first; bounded in number."""
    out: list[_Set] = []
    for size in range(1, len(nodes) + 1):
        for cols in combos(nodes, size):
            if len(out) >= most:
                return out
            out.append(_Set(frozenset(cols), frozenset()))
    return out


def random_forest(nodes: Sequence[str], forbidden: set[Edge], rng: random.Random) -> list[Edge]:
    """Every node after the first takes one random allowed parent among the nodes before it."""
    edges = []
    for i, child in enumerate(nodes):
        options = [p for p in nodes[:i] if (p, child) not in forbidden]
        if options:
            edges.append((rng.choice(options), child))
    return edges


def staged(counts: DataFrame, nodes: Sequence[str], seed: int) -> DataFrame:
    """Split every combination's rows over the stages at which they enter the sample, as ``(nodes, n, entered)``.

    A sample of share f holds floor(n f + u) of a combination's n rows, where u in [0, 1) is drawn by a hash of the
    combination: within one row of the share, right on average over combinations, and the same under any partitioning.
    """
    u = hash_uniform(*[F.col(c) for c in nodes], seed)
    upto = [F.least(F.col("n"), F.floor(F.col("n") * F.lit(FIRST_FRACTION * 2 ** (s + 1)) + u)) for s in range(STAGES - 1)]
    upto.append(F.col("n"))
    entries = [
        F.struct(F.lit(s).alias("entered"), (upto[s] - (upto[s - 1] if s else F.lit(0))).cast("bigint").alias("n")) for s in range(STAGES)
    ]
    return counts.select(*nodes, F.explode(F.array(*entries)).alias("e")).select(*nodes, "e.entered", "e.n").where("n > 0")


def neighbours(nodes: Sequence[str], edges: Sequence[Edge], forbidden: set[Edge], max_arcs: int) -> dict[str, list[list[Edge]]]:
    """All networks one move away, by kind of move."""
    present = set(edges)
    out: dict[str, list[list[Edge]]] = {"add": [], "delete": [], "reverse": []}
    if len(edges) < max_arcs:
        for a in nodes:
            for b in nodes:
                if a != b and not {(a, b), (b, a)} & present and (a, b) not in forbidden:
                    out["add"].append([*edges, (a, b)])
    for e in edges:
        rest = [x for x in edges if x != e]
        out["delete"].append(rest)
        if (e[1], e[0]) not in forbidden:
            out["reverse"].append([*rest, (e[1], e[0])])
    return out


def propose(moves: dict[str, list[list[Edge]]], edges: list[Edge], legal, rng: random.Random) -> list[Edge]:
    """A random legal move of a random kind; the same network when none is found."""
    options = moves[rng.choice(["add", "delete", "reverse"])]
    for candidate in rng.sample(options, min(ADD_TRIES, len(options))):
        if legal(candidate):
            return candidate
    return edges


def learn_structure(
    df: DataFrame,
    cols: Sequence[str],
    iterations: int = 100,
    seed: int = 0,
    black_list: Iterable[Edge] = (),
) -> Structure:
    """Learn the edges between categorical columns.

    Starts from a random forest, tries one random move per iteration, keeps it when the score
    grows and otherwise restarts from one of the ten best networks. The arc cap and the sample
    grow every quarter; the networks held are scored again when the sample grows. With
    ``iterations=0`` the forest is the result. Only observed cells are counted, so a family's
    number of possible cells limits nothing but its score.
    """
    nodes, forbidden, rng = list(cols), set(black_list), random.Random(seed)
    last = STAGES - 1  # stages 0..2 are growing samples, the last one is all rows
    table = staged(compress(df, nodes), nodes, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cards = cardinalities(table, nodes)
        scores = _Scores(table, cards, nodes)
        forest = random_forest(nodes, forbidden, rng)

        def legal(edges: list[Edge]) -> bool:
            return is_acyclic(nodes, edges)

        current, stage, score = forest, 0, 0.0
        best: list[tuple[float, list[Edge]]] = []
        quarter, max_arcs = max(1, iterations // STAGES), len(nodes) // 2
        for i in range(iterations):
            if i % quarter == 0:
                stage = min(i // quarter, last)
                max_arcs = min(max_arcs + 2, 2 * len(nodes))
                score = scores.network(stage, current)
                best = sorted(((scores.network(stage, e), e) for _, e in best), reverse=True)
            moves = neighbours(nodes, current, forbidden, max_arcs)
            candidate = propose(moves, current, legal, rng)
            needed = as_families(nodes, candidate)
            if not scores.has(needed):
                reachable = (f for kind in moves.values() for m in kind if legal(m) for f in as_families(nodes, m))
                scores.fetch(needed, reachable)
            new_score = scores.network(stage, candidate)
            if new_score > score + TIE * abs(score):
                current, score = candidate, new_score
                best = sorted([*best, (score, current)], reverse=True)[:REPOSITORY_SIZE]
            elif best:
                score, current = rng.choice(best)
        finalists = [forest, current, *[e for _, e in best]]
        ranked = sorted(((scores.network(last, e), e) for e in finalists), key=lambda s: s[0], reverse=True)
        forest_score = scores.network(last, forest)
        if iterations == 0:
            return Structure(nodes, forest, forest_score, forest, forest_score, scores.jobs)
        return Structure(nodes, ranked[0][1], ranked[0][0], forest, forest_score, scores.jobs)
    finally:
        table.unpersist()
