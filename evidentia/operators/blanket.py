"""Markov blankets by conditional tests: grow and shrink with a G-test on batched contingency tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.families import cardinalities, compress
from evidentia.operators.structure import STAGES, SetCounts


def critical_value(freedom: int, alpha: float) -> float:
    """What a chi-square variable stays below with probability 1 - alpha, by the cube-root approximation of Wilson and Hilferty (1931)."""
    z = NormalDist().inv_cdf(1 - alpha)
    spread = 2 / (9 * freedom)
    return freedom * (1 - spread + z * math.sqrt(spread)) ** 3


@dataclass(frozen=True)
class Test:
    """Is ``feature`` independent of the target given ``given``? ``g`` is twice the rows times their mutual information in nats."""

    feature: str
    given: tuple[str, ...]
    g: float
    limit: float
    rows: int
    cells: int

    @property
    def ratio(self) -> float:
        return float(f"{self.g / self.limit:.10g}")  # sums of doubles have no fixed order


class BlanketSearch:
    """Tests of a target column against others, many in one job on counts that are made once.

    Degrees of freedom are (r_x - 1)(r_t - 1) times the states of the given columns. Rows that miss a value of a test's columns do not count for
    it. A test with fewer than ``least`` rows for every possible cell says nothing: such a feature is neither added nor taken out.
    """

    def __init__(self, df: DataFrame, target: str, cols: Sequence[str], alpha: float = 0.01, least: float = 5.0) -> None:
        self.target, self.cols, self.alpha, self.least = target, list(cols), alpha, least
        nodes = [target, *self.cols]
        table = compress(df, nodes).withColumn("entered", F.lit(STAGES - 1)).persist()
        self.table, self.cards = table, cardinalities(table, nodes)
        self.counts = SetCounts(table, nodes)
        self.tests: list[Test] = []

    def run(self, wanted: Sequence[tuple[str, tuple[str, ...]]]) -> list[Test]:
        """One test for every ``(feature, given)``."""
        sets = {}
        for x, given in wanted:
            full = frozenset(given) | {x, self.target}
            sets[x, given] = [self.counts.of(s, full) for s in (full, full - {self.target}, full - {x}, frozenset(given))]
        self.counts.fetch([s for group in sets.values() for s in group])
        out = []
        for (x, given), group in sets.items():
            (both, rows), (own, _), (other, _), (base, _) = (self.counts.value(s, STAGES - 1, group[0]) for s in group)
            states = math.prod(self.cards[c] for c in given)
            freedom = max(1, (self.cards[x] - 1) * (self.cards[self.target] - 1) * states)
            out.append(Test(x, given, 2 * (both - own - other + base), critical_value(freedom, self.alpha), rows, self.cards[x] * self.cards[self.target] * states))
        self.tests += out
        return out

    def enough(self, t: Test) -> bool:
        return t.rows >= self.least * t.cells

    def find(self) -> list[str]:
        """Grow: as long as some feature depends on the target given the blanket, add the one that exceeds its limit most. Shrink: as long as some
        feature of it is independent given the others, take out the one furthest below its limit. In the order of ``cols``."""
        place = {c: i for i, c in enumerate(self.cols)}
        blanket: list[str] = []
        key = lambda cs: tuple(sorted(cs, key=place.__getitem__))
        try:
            while rest := [c for c in self.cols if c not in blanket]:
                found = [t for t in self.run([(c, key(blanket)) for c in rest]) if self.enough(t) and t.ratio > 1]
                if not found:
                    break
                blanket.append(max(found, key=lambda t: (t.ratio, -place[t.feature])).feature)
            while blanket:
                found = [t for t in self.run([(c, key(set(blanket) - {c})) for c in blanket]) if self.enough(t) and t.ratio <= 1]
                if not found:
                    break
                blanket.remove(min(found, key=lambda t: (t.ratio, place[t.feature])).feature)
        finally:
            self.table.unpersist()
        return list(key(blanket))
