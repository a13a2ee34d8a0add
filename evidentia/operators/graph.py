"""Directed graphs of columns. A few dozen nodes: plain driver data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edge = tuple[str, str]


def parents_of(nodes: Sequence[str], edges: Iterable[Edge]) -> dict[str, list[str]]:
    """Parents of every node in node order; a node without an edge is a node all the same."""
    place = {c: i for i, c in enumerate(nodes)}
    parents: dict[str, list[str]] = {c: [] for c in nodes}
    for parent, child in edges:
        if parent not in place or child not in place:
            raise ValueError(f"edge {parent}->{child} names an unknown column")
        parents[child].append(parent)
    return {c: sorted(set(p), key=place.__getitem__) for c, p in parents.items()}


def topological(nodes: Sequence[str], edges: Iterable[Edge]) -> list[str]:
    """Nodes with parents first; raises ``ValueError`` on a cycle."""
    try:
        return list(TopologicalSorter(parents_of(nodes, edges)).static_order())
    except CycleError as e:
        raise ValueError(f"the edges form a cycle: {e.args[1]}") from None


def is_acyclic(nodes: Sequence[str], edges: Iterable[Edge]) -> bool:
    try:
        topological(nodes, edges)
    except ValueError:
        return False
    return True


def ancestors(node: str, parents: dict[str, list[str]]) -> set[str]:
    seen: set[str] = set()
    todo = list(parents[node])
    while todo:
        p = todo.pop()
        if p not in seen:
            seen.add(p)
            todo += parents[p]
    return seen


def connected(edges: Iterable[Edge], sources: Iterable[str], given: Iterable[str]) -> set[str]:
    """Every column that some source is d-connected with, given others: reachability on (column, direction of arrival).

    A path goes on through a column that is not given, unless it comes along two arrows into it (a collider); through a collider it goes on
    if that or a descendant of it is given.
    """
    into: dict[str, set[str]] = {}
    out: dict[str, set[str]] = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
        out.setdefault(a, set()).add(b)
    given = set(given)
    opened, todo = set(), list(given)  # the given columns and their ancestors
    while todo:
        c = todo.pop()
        if c not in opened:
            opened.add(c)
            todo += into.get(c, ())
    seen: set[tuple[str, bool]] = set()
    front = [(c, False) for c in sources]  # True: arrived along an arrow
    while front:
        at = front.pop()
        if at in seen:
            continue
        seen.add(at)
        c, along = at
        if not along and c not in given:
            front += [(p, False) for p in into.get(c, ())]
        if along and c in opened:
            front += [(p, False) for p in into.get(c, ())]
        if c not in given:
            front += [(d, True) for d in out.get(c, ())]
    return {c for c, _ in seen if c not in given}


def descendants(edges: Iterable[Edge], sources: Iterable[str]) -> set[str]:
    """The sources and all that lies below them."""
    edges, seen, todo = list(edges), set(), list(sources)
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [b for a, b in edges if a == c]
    return seen


def backdoor_set(edges: Iterable[Edge], treatments: Iterable[str], outcome: str, unusable: Iterable[str] = ()) -> list[str] | None:
    """A minimal set of columns that meets the backdoor condition, in order of names; ``None`` if there is none.

    No column of it lies below a treatment, and it separates the treatments from the outcome once the arrows out of the treatments are
    taken away. If any set does, the usable ancestors of treatments and outcome together do; from these, columns are left out one by
    one, the last name first, as long as the rest still separates. ``unusable`` columns, such as unobserved ones, are never chosen.
    """
    edges, treatments = list(edges), set(treatments)
    if outcome in treatments:
        raise ValueError("the outcome is a treatment")
    rest = [(a, b) for a, b in edges if a not in treatments]
    turned = [(b, a) for a, b in edges]
    barred = descendants(edges, treatments) | {outcome} | set(unusable)
    chosen = sorted(descendants(turned, {*treatments, outcome}) - barred)
    separates = lambda z: outcome not in connected(rest, treatments, z)
    if not separates(chosen):
        return None
    for c in reversed(list(chosen)):
        if separates([x for x in chosen if x != c]):
            chosen.remove(c)
    return chosen


def parent_table(edges: DataFrame) -> DataFrame:
    """``(child, parents)`` from stored ``(parent, child)`` rows."""
    return edges.groupBy("child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def allowed_edges(candidates: DataFrame, black_list: DataFrame) -> DataFrame:
    """Candidate ``(parent, child)`` rows that are not black-listed."""
    return candidates.join(black_list, ["parent", "child"], "left_anti")
