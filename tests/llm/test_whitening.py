"""Whitening against a dense eigensolver and exact whole numbers."""

import math

import numpy as np
import pytest

from evidentia.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, None) for i, v in rows], "vec_id bigint, embedding array<float>, label int, n bigint, component string")


def reference(rows, components=32):
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)) + 1_000_000
    n, c = len(x), x - x.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > 1e-10 * values[0]).sum()))
    whole = x.astype(int)
    deviation = [sum(int(e) ** 2 for e in r) for r in n * whole - whole.sum(0)]
    return n, deviation, c @ axes[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum()


def check(got, rows, components=32):
    n, deviation, white, explained = reference(rows, components)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == white.size
    for k, (i, _) in enumerate(rows):
        for j in range(white.shape[1]):
            r = by[(i, j + 1)]
            assert r.n == n and r.deviation == deviation[k]
            assert math.isclose(r.explained, explained[j], rel_tol=1e-9)
            assert r.identity_error < 1e-9
    signs = [np.sign(sum(by[(i, j + 1)].whitened * white[k, j] for k, (i, _) in enumerate(rows))) for j in range(white.shape[1])]
    for k, (i, _) in enumerate(rows):
        for j, s in enumerate(signs):
            assert math.isclose(by[(i, j + 1)].whitened, s * white[k, j], rel_tol=1e-7, abs_tol=1e-8)


def vectors(n, dim, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, dim)) * np.linspace(3, 0.5, dim)
    if rank:
        x = np.round(rng.integers(-4, 5, (n, rank))) @ rng.integers(-3, 4, (rank, dim)) / 64.0 * 2
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


@pytest.mark.parametrize("n, dim, rank, components", [(300, 40, None, 32), (200, 6, None, 32), (10, 24, None, 32), (200, 16, 5, 32), (150, 12, None, 4)])
def test_against_eigensolver(spark, n, dim, rank, components):
    rows = vectors(n, dim, n, rank)
    check(whitening.whiten(table(spark, rows).repartition(3), components).collect(), rows, components)


def test_odd_rows(spark):
    rows = vectors(60, 5, 3)
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [nan, 0, 0, 0, 0]), (103, [inf, 0, 0, 0, 0]), (104, [None, 0, 0, 0, 0]), (105, [1.0, 2.0]), (106, [3e38, 0, 0, 0, 0])]
    bad = [(i, None if v is None else [None if e is None else float(e) for e in v]) for i, v in bad]
    check(whitening.whiten(table(spark, rows + bad)).collect(), rows)
    got = whitening.whiten(table(spark, [*rows, (None, rows[0][1]), rows[1]])).collect()
    assert len(got) == 62 * 5 and sum(r.vec_id is None for r in got) == 5 and {r.n for r in got} == {62}
    assert whitening.whiten(table(spark, []).limit(0)).collect() == []
    assert whitening.whiten(table(spark, bad[:5])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e9, 0.0]), (2, [0.0, 0.5]), (3, [0.0, 0.0])]
    got = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(table(spark, rows)).collect()}
    whole = [[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in rows]
    sums = [sum(c) for c in zip(*whole)]
    exact = [sum((3 * e - s) ** 2 for e, s in zip(v, sums)) for v in whole]
    assert exact[0] > 2**63 and got[(1, 1)] is None
    assert got[(2, 1)] is None and exact[1] > 2**63


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for rank in (0, 1, 7, 12):
        a = rng.normal(0, 1, (12, rank)) * np.geomspace(1, 1e-4, rank) if rank else np.zeros((12, 0))
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape == (12, rank) and np.allclose(factor @ factor.T, v, atol=1e-15)
        values, axes = whitening.jacobi(factor)
        assert np.allclose(values, np.sort(np.linalg.svd(a, compute_uv=False) ** 2)[::-1] if rank else [], rtol=1e-9)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and np.allclose(axes * values @ axes.T, v, atol=1e-12)
