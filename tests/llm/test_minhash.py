"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from evidentia.llm import minhash
from tests.llm.cases import ODD_ROWS, docs_table, no_docs, odd_docs


def sets_of(rows):
    out = {}
    for i, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    return out


def brute(sets):
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(8, 90))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy).upper() if n % 5 == 0 else "\n".join(copy)))
            n += 1
    chain = [rng.choice(words) for _ in range(60)]  # each is linked with its neighbours alone
    for k in range(12):
        rows.append((n + k, " ".join(chain[k * 2 : k * 2 + 40])))
    shared = [rng.choice(words) for _ in range(30)]  # a passage in many documents makes no link
    for k in range(30):
        rows.append((n + 50 + k, " ".join(shared + [f"own{k}x{i}" for i in range(30)])))
    rows += [(n + 100, "a b c d e f g"), (n + 101, "a b c d e f g h"), (n + 102, "few words"), (n + 103, "FEW  words"), (n + 104, "few words more")]
    return rows


def test_against_all_pairs(spark):
    rows = texts()
    sets = sets_of(rows)
    expected = brute(sets)
    got = minhash.near_duplicates(docs_table(spark, [(i, t, "en") for i, t in rows]).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), expected[i], expected[i] == i) for i in sets}
    assert len(got) == len(rows)


def test_exactly_at_the_limit(spark):
    words = [f"v{i}" for i in range(200)]
    a = words[:100]  # 96 shingles; with 24 of 120 changed the pair stands at 72 / 96
    rows = [(1, " ".join(a)), (2, " ".join(a[:76])), (3, " ".join(a[:75]))]
    sets = sets_of(rows)
    assert 100 * len(sets[1] & sets[2]) == 75 * len(sets[1] | sets[2])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_table(spark, [(i, t, None) for i, t in rows])).collect()}
    assert got == brute(sets) == {1: 1, 2: 1, 3: 1}
    assert not minhash.linked(minhash.shingles(minhash.words_of(rows[0][1])), minhash.shingles(minhash.words_of(rows[2][1])), 75)


def test_links_that_leaders_miss_are_found_in_blocks():
    """Texts of different components of a bucket, with no leader among them."""
    import pandas as pd

    rng = random.Random(0)
    base = [f"u{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(base[k : k + 80])) for k in range(10)]
    sketch = minhash.band_keys(minhash.sketches([minhash.shingles(minhash.words_of(t)) for _, t in rows]))
    key = int(sketch[0, 0]) & ~((1 << 58) - 1)  # band 0
    group = pd.DataFrame({"key": key, "id": [i for i, _ in rows], "component": [i for i, _ in rows], "side": 0, "text": [t for _, t in rows]})
    links = minhash._blocks(75)(group)
    root = {i: i for i, _ in rows}
    for a, b in links.itertuples(index=False):
        old, new = root[a], root[b]
        root = {i: new if r == old else r for i, r in root.items()}
    assert len(set(root.values())) == 1 and len(links) == 9


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 50).astype(np.uint64)])) for _ in range(2))
    x, y = minhash.sketches([a, b])
    assert abs((x == y).mean() - 0.75) < 0.15
    tiny = minhash.sketches([np.array([5], np.uint64), np.array([5, 6], np.uint64)])
    assert (tiny < np.iinfo(np.uint64).max).all() and 0.2 < (tiny[0] == tiny[1]).mean() < 0.8


def test_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD_ROWS)
    sets = sets_of([(i, t) for i, t, _ in ODD_ROWS if i is not None])
    expected = brute(sets)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_lower_similarities_are_refused(spark):
    for per_cent in (74, 0, 101):
        with pytest.raises(ValueError, match="per_cent"):
            minhash.near_duplicates(no_docs(spark), per_cent)
