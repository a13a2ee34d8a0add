"""Products and sums of probability tables that are too large to lay out.

A table with the prior is its observed part, which is sparse, plus a part that depends on the parents' total alone, plus a
constant: P(c | pa) = n / (n_pa + b) + [a / (n_pa + b) - 1 / r] + 1 / r. The bracket is zero for parents that never occurred. So a
factor is a sum of terms, a term a weight and sparse parts that are multiplied, and columns that no part holds don't matter.
Summing a column out joins only the parts that hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.cpt import Network
from evidentia.operators.families import combinations
from evidentia.operators.graph import ancestors, topological
from evidentia.session import cut_lineage


@dataclass(eq=False)
class Part:
    """Values ``v`` on the combinations of ``cols`` that have one; zero elsewhere."""

    cols: tuple[str, ...]
    table: DataFrame


@dataclass
class Term:
    weight: float
    parts: list[Part] = field(default_factory=list)


def table_terms(network: Network, node: str) -> list[Term]:
    """The table of a node as a sum of terms."""
    parents = network.parents[node]
    table = network.node_table(node)
    if network.is_dense(node):
        return [Term(1.0, [Part((*parents, node), table.select(*parents, node, F.col("prob").alias("v")))])]
    q, r = float(combinations(network.cards, parents)), float(network.cards[node])
    a, b = network.ess / (r * q), network.ess / q
    if not parents:
        total = table.agg(F.sum("n")).first()[0] or 0
        seen = table.where("n > 0").select(node, (F.col("n") / F.lit(total + b)).alias("v"))
        return [Term(1.0, [Part((node,), seen)]), Term(a / (total + b))]
    totals = table.groupBy(*parents).agg(F.sum("n").alias("n_pa"))
    seen = table.where("n > 0").join(totals, parents).select(*parents, node, (F.col("n") / (F.col("n_pa") + F.lit(b))).alias("v"))
    rest = totals.select(*parents, (F.lit(a) / (F.col("n_pa") + F.lit(b)) - F.lit(1.0 / r)).alias("v"))
    return [Term(1.0, [Part((*parents, node), cut_lineage(seen))]), Term(1.0, [Part(tuple(parents), cut_lineage(rest))]), Term(1.0 / r)]


class Elimination:
    """Sums columns out of sums of terms; equal parts are joined and added up once."""

    def __init__(self, cards: dict[str, int]) -> None:
        self.cards = cards
        self.known: dict[tuple, Part | float] = {}

    def product(self, sums: Sequence[list[Term]]) -> list[Term]:
        out = [Term(1.0)]
        for terms in sums:
            out = [Term(a.weight * b.weight, [*a.parts, *b.parts]) for a in out for b in terms]
        return out

    def without(self, terms: list[Term], c: str) -> list[Term]:
        """The terms with ``c`` summed out."""
        out = []
        for term in terms:
            holding = [p for p in term.parts if c in p.cols]
            rest = [p for p in term.parts if c not in p.cols]
            if not holding:
                out.append(Term(term.weight * self.cards[c], rest))
                continue
            summed = self._summed(holding, c)
            out.append(Term(term.weight * summed, rest) if isinstance(summed, float) else Term(term.weight, [*rest, summed]))
        return self.merged(out)

    def _summed(self, holding: list[Part], c: str) -> Part | float:
        key = (c, *sorted(id(p) for p in holding))
        if key not in self.known:
            cols, joined = holding[0].cols, holding[0].table
            for p in holding[1:]:
                shared = [x for x in p.cols if x in cols]
                joined = joined.join(p.table.withColumnRenamed("v", "w"), shared).withColumn("v", F.col("v") * F.col("w")).drop("w")
                cols = (*cols, *[x for x in p.cols if x not in cols])
            left = tuple(x for x in cols if x != c)
            if left:
                self.known[key] = Part(left, cut_lineage(joined.groupBy(*left).agg(F.sum("v").alias("v"))))
            else:
                self.known[key] = float(joined.agg(F.sum("v")).first()[0] or 0.0)
        return self.known[key]

    def merged(self, terms: list[Term]) -> list[Term]:
        """Terms with the same parts, or with one part over the same columns, put together."""
        weights: dict[tuple, float] = {}
        parts: dict[tuple, list[Part]] = {}
        for t in terms:
            key = tuple(sorted(id(p) for p in t.parts))
            weights[key] = weights.get(key, 0.0) + t.weight
            parts[key] = t.parts
        alone: dict[tuple, list[tuple]] = {}
        for key, held in parts.items():
            if len(held) == 1:
                alone.setdefault(tuple(sorted(held[0].cols)), []).append(key)
        out = [Term(weights[k], p) for k, p in parts.items() if len(p) != 1]
        for cols, keys in alone.items():
            if len(keys) == 1:
                out.append(Term(weights[keys[0]], parts[keys[0]]))
                continue
            union = None
            for k in keys:
                one = parts[k][0].table.select(*cols, (F.col("v") * F.lit(weights[k])).alias("v"))
                union = one if union is None else union.unionByName(one)
            out.append(Term(1.0, [Part(cols, cut_lineage(union.groupBy(*cols).agg(F.sum("v").alias("v"))))]))
        return out


def marginal_terms(network: Network, node: str, present: Sequence[str]) -> tuple[list[Term], list[Term]]:
    """P(node and the present parents) and P(the present parents), all other ancestors summed out, as sums of terms."""
    shown = [p for p in network.parents[node] if p in present]
    involved = ancestors(node, network.parents) | {node}
    sums = [({c, *network.parents[c]}, table_terms(network, c)) for c in involved]
    work = Elimination(network.cards)
    for c in [c for c in reversed(topological(network.nodes, network.edges)) if c in involved and c not in {node, *shown}]:
        group, rest = [s for s in sums if c in s[0]], [s for s in sums if c not in s[0]]
        scope = set().union(*[s[0] for s in group]) - {c}
        sums = [*rest, (scope, work.without(work.product([s[1] for s in group]), c))]
    joint = work.merged(work.product([s[1] for s in sums]))
    return joint, work.without(joint, node)
