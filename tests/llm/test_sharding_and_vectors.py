"""Jump shards and near vectors against brute force."""

import math
import zlib

import numpy as np
import pytest

from evidentia.llm import sharding, vectors
from tests.llm.cases import ODD_ROWS, docs_table, no_docs, odd_docs


def naive_jump(key, shards):
    state, place, ahead = key % 2**64, 0, 0
    while ahead < shards:
        place = ahead
        state = (state * sharding.STEP + 1) % 2**64
        ahead = int((place + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return place


def test_jump_hash():
    keys = np.concatenate([np.arange(-50, 2000), np.array([2**63 - 1, -(2**63)])]).astype(np.int64)
    for n in (1, 2, 40, 41):
        assert sharding.jump_hash(keys.view(np.uint64), n).tolist() == [naive_jump(int(k), n) for k in keys]
    old, new = (sharding.jump_hash(keys.view(np.uint64), n) for n in (40, 41))
    moved = old != new
    assert set(new[moved]) == {40} and 0.5 * len(keys) / 41 < moved.sum() < 2 * len(keys) / 41


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = sharding.shard_rows(docs.unionByName(docs_table(spark, [(i, "x" * (i % 7), None) for i in range(100, 700)]), allowMissingColumns=True), 5).collect()
    rows = [(i, t) for i, t, _ in ODD_ROWS] + [(i, "x" * (i % 7)) for i in range(100, 700)]
    size = lambda t: len((t or "").encode()) + 16
    expected = sorted((i is None, i or 0, size(t), zlib.crc32((t or "").encode()), naive_jump(i or 0, 5), naive_jump(i or 0, 6)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == expected
    for s in range(5):
        own = sorted((r.slot, r.doc_id if r.doc_id is not None else -1) for r in got if r.shard == s)
        assert [k for k, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)
    assert sharding.shard_rows(no_docs(spark)).count() == 0


def near_table(spark, rows):
    schema = "vec_id bigint, embedding array<float>, label int, id bigint, shard int, root string"
    return spark.createDataFrame([(i, v, label, None, None, None) for i, v, label in rows], schema)


def brute(rows, limit=0.93):
    good = [(k, i, np.array(v, np.float32).astype(float), label) for k, (i, v, label) in enumerate(rows)
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for k, _, v, a in good:
        for j, _, w, b in good:
            if k != j and a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= limit:
                links[k].add(j)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root = min((rows[j][0] for j in seen), default=i) if i is not None else None
        out.append((i, len(links[k]), root, i is None or root == i))
    return out


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for c in range(12):
            centre = rng.normal(0, 1, 16)
            for _ in range(rng.integers(1, 14)):
                rows.append((len(rows), (centre + rng.normal(0, rng.choice([0.05, 0.2, 0.35]), 16)).astype(np.float32).tolist(), label))
    same = rows[0][1]
    rows += [(1000 + k, same, 0) for k in range(5)] + [(1005, same, 1), (1006, same, None), (1007, None, 0), (1008, [0.0] * 16, 0), (1009, [], 0)]
    rows += [(1010, [float("nan")] * 16, 0), (1011, [float("inf")] + [0.0] * 15, 0), (1012, [None] + [1.0] * 15, 0), (None, same, 0), (1013, same[:8], 0), (1003, same, 0)]
    rows += [(1014, [3e38] * 16, 0), (1015, [1e-38] * 16, 0)]
    key = lambda r: (r[0] is None, r[0] or 0, *[str(x) for x in r[1:]])
    for size in (8192, 40):
        got = vectors.near_vectors(near_table(spark, rows), shard_rows=size).collect()
        assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute(rows), key=key)
        assert all(r.recall is None or r.recall >= 0.98 for r in got)
    assert vectors.near_vectors(near_table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 700])
def test_graph_finds_neighbours(n):
    rng = np.random.default_rng(n)
    x = vectors.unit(rng.normal(0, 1, (n, 24)))
    graph = vectors.Graph(x)
    again = vectors.Graph.unpack(x, *graph.pack())
    found = right = 0
    for i in range(0, n, 5):
        near = {j for _, j in again.near(x[i].astype(np.float32), 40)[:10]}
        found += len(near & set(np.argsort(-(x @ x[i]))[:10].tolist()))
        right += min(10, n)
    assert found >= 0.9 * right


def clusters(n, dim, seed):
    """Vectors of which some lie in clusters, as rows of one label."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (n // 8, dim))
    x = np.vstack([np.repeat(centres, 4, axis=0) + rng.normal(0, 0.16, (n // 8 * 4, dim)), rng.normal(0, 1, (n - n // 8 * 4, dim))])
    return x.astype(np.float32)


def test_large_labels_over_several_shards(spark):
    """Every link of two labels of some thousand vectors, in one shard and in four."""
    x, y = clusters(3000, 24, 1), clusters(2500, 24, 2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000 + i, v.tolist(), 1) for i, v in enumerate(y)]
    expected = {}
    for first, part in ((0, x), (10_000, y)):
        u = vectors.unit(part)
        near = u @ u.T >= 0.93
        expected.update({first + i: int(n) - 1 for i, n in enumerate(near.sum(1))})
    for size in (8192, 800):
        got = {r.vec_id: r for r in vectors.near_vectors(near_table(spark, rows), shard_rows=size).collect()}
        right, found = sum(expected.values()), sum(r.n_links for r in got.values())
        assert all(r.n_links <= expected[i] for i, r in got.items()) and right > 3000
        assert found >= 0.995 * right
        assert {r.recall >= 0.98 for r in got.values()} == {True}


def test_low_recall_widens_the_beams_of_that_label(spark, monkeypatch):
    """A search that finds nothing at first is repeated for the labels whose audit fails, and only for them."""
    real, tried = vectors._link, []

    def narrow(limit, width):
        tried.append(width)
        run = real(limit, width)
        if width > 32:
            return run

        def lose(parts):
            for out in run(parts):
                yield out[out["label"] != 0]

        return lose

    monkeypatch.setattr(vectors, "_link", narrow)
    x = clusters(240, 16, 3)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    got = vectors.near_vectors(near_table(spark, rows)).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(brute(rows)) and tried == [32, 64]
    assert {r.recall for r in got} == {1.0}


def test_failed_walks_and_groups():
    rng = np.random.default_rng(0)
    x = vectors.unit(np.vstack([rng.normal(0, 1, (1, 16)) + rng.normal(0, 0.05, (400, 16)), rng.normal(0, 1, (600, 16))]))
    hits = vectors.search(vectors.Graph(x, m=6, width=20), x, 0.93, 2)
    true = x @ x.T >= 0.93
    assert hits[true].mean() > 0.99
    graph = vectors.Graph(x[:300])
    graph.layers, graph.top = [{i: [] for i in range(300)}], 0  # no way from node to node
    assert (vectors.search(graph, x[:20], 0.93, 4) >= true[:20, :300]).all()
    chain = np.zeros((4, 4), bool)
    chain[[0, 1, 1, 3], [1, 1, 2, 3]] = True
    rows, columns = vectors.groups(chain)
    assert rows.tolist() == [0, 0, 2, 3] and columns.tolist() == [-1, 0, 0, 3]
