"""Small tables made by rules, and plain formulas over lists that give the expected values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

#: Days with weather: the sprinkler runs on every third day without rain, the lawn is wet after either.
DAYS = 36
RAIN = [int(i * i % 7 in (1, 2)) for i in range(DAYS)]
SPRINKLER = [int(i % 3 == 0 and not r) for i, r in enumerate(RAIN)]
WET = [int(bool(r or s) != (i % 11 == 5)) for i, (r, s) in enumerate(zip(RAIN, SPRINKLER))]
SLIP = [int(w and i % 4 != 1) for i, w in enumerate(WET)]
NODES = ["rain", "sprinkler", "wet"]
CHAIN = [("rain", "sprinkler"), ("sprinkler", "wet")]
SCHEMA = "row_id bigint, rain int, sprinkler int, wet int, slip int"


def day_rows() -> list[tuple[int, ...]]:
    return [(i, *r) for i, r in enumerate(zip(RAIN, SPRINKLER, WET, SLIP))]


def column(name: str) -> list[int]:
    return {"rain": RAIN, "sprinkler": SPRINKLER, "wet": WET, "slip": SLIP}[name]


def entropy(values: Sequence) -> float:
    """Bits of the empirical distribution."""
    n = len(values)
    return -sum(k / n * math.log2(k / n) for k in Counter(values).values())


def entropy_given(y: Sequence, *keys: Sequence) -> float:
    groups = list(zip(*keys)) if keys else [()] * len(y)
    return sum(groups.count(g) / len(y) * entropy([b for a, b in zip(groups, y) if a == g]) for g in set(groups))


def bdeu(node: str, parents: Sequence[str], ess: float = 5.0) -> dict[tuple[int, ...], float]:
    """P(node | parents) with a uniform Dirichlet prior, by (parents..., node)."""
    combos = [()]
    for p in parents:
        combos = [(*c, v) for c in combos for v in sorted(set(column(p)))]
    states = sorted(set(column(node)))
    seen = list(zip(*[column(p) for p in parents], column(node))) if parents else [(v,) for v in column(node)]
    prior = ess / len(combos)
    out = {}
    for c in combos:
        total = sum(1 for s in seen if s[:-1] == c)
        for v in states:
            out[(*c, v)] = (seen.count((*c, v)) + prior / len(states)) / (total + prior)
    return out


def bic(node: str, parents: Sequence[str]) -> float:
    """Log-likelihood of the family minus half its parameters times ln n."""
    seen = list(zip(*[column(p) for p in parents], column(node)))
    above = Counter(s[:-1] for s in seen)
    likelihood = sum(k * math.log(k / above[s[:-1]]) for s, k in Counter(seen).items())
    q = math.prod(len(set(column(p))) for p in parents)
    return likelihood - math.log(DAYS) / 2 * q * (len(set(column(node))) - 1)
