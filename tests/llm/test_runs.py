"""Periodic runs against brute force, and the transform against plain sums."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from evidentia.llm import periodic_runs as runs
from tests.llm.cases import ODD_ROWS, docs_table, no_docs, odd_docs


def brute(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        size, words = rng.choice([0, 3, 23, 24, 25, 60, 200, 400, 700]), rng.choice([1, 2, 3, 5, 50, 1000])
        w = [rng.randrange(words) for _ in range(size)]
        for _ in range(rng.randrange(4) if size > 30 else 0):
            a, p = rng.randrange(size), rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 100])
            for i in range(a + p, min(size, a + int(p * rng.uniform(2.5, 6)) + rng.randrange(20))):
                w[i] = w[i - p]
        yield w


def test_transform_and_inverse():
    rng = np.random.default_rng(0)
    for field in runs.FIELDS:
        for size in (2, 16, 256):
            x = rng.integers(0, field[0], (3, size)).astype(np.uint64)
            assert (runs.inverse(runs.transform(x, field), field) == x).all()


@pytest.mark.parametrize("high", [2, 3, 3_000_000])
def test_zero_mismatches(high):
    rng = np.random.default_rng(high)
    x = rng.integers(0, 3, 700) * (high // 3 or 1) + (high > 3) * rng.integers(0, 2)
    x[200:500] = np.tile(x[200:225], 12)
    for b in (8, 16, 32):
        got = set(zip(*(a.tolist() for a in runs.zero_mismatches(x.astype(np.int64), b))))
        low = 1 if b == runs.BASE else b
        expected = {(s, d) for s in range(0, 700, b) for d in range(low, 2 * b) if s + d + b <= 700 and (x[s : s + b] == x[s + d : s + d + b]).all()}
        assert got == expected and (got or b != 16)


def test_values_beyond_all_fields_are_refused():
    with pytest.raises(ValueError, match="fields"):
        runs.zero_mismatches(np.array([0, 2**45] * 8), 8)


def test_runs_of_several_texts_together():
    every = list(texts(200, 3))
    for i in range(0, len(every), 10):
        part = every[i : i + 10]
        doc, code = np.repeat(np.arange(len(part)), [len(w) for w in part]), np.array([c for w in part for c in w], np.int64)
        first = np.cumsum([0] + [len(w) for w in part])
        expected = [(int(first[k]) + s, n, q) for k, w in enumerate(part) for s, n, q in brute(w)]
        assert runs.find_runs(doc, code) == sorted(expected, key=lambda r: (r[0], r[2]))


def expected_row(key, text, rehearse):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if rehearse and key is not None and n and h % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, best[1] * 1000 // best[2])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(found), *top, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(kept)))


@pytest.mark.parametrize("rehearse", [False, True])
def test_table(spark, rehearse, monkeypatch):
    rows = [(i, t) for i, t, _ in ODD_ROWS if not (t and len(t) > 10_000)]
    rows += [(100 + i, "\u0085x ".join(f"w{c}" for c in w)) for i, w in enumerate(texts(120, 5))]
    docs = odd_docs(spark).where("length(text) < 10000 OR text IS NULL").unionByName(docs_table(spark, [(i, t, None) for i, t in rows if i is not None and i >= 100]), allowMissingColumns=True)
    got = runs.periodic_runs(docs.repartition(3), rehearse).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected_row(i, t, rehearse) for i, t in rows), key=key)
    assert sum(r.n_runs for r in got) > 20
    assert runs.periodic_runs(no_docs(spark), rehearse).count() == 0


def test_very_long_text(spark):
    period = [f"p{i}" for i in range(9000)]
    text = " ".join(["start"] + period * 4 + ["end"] + ["same"] * 50_000)
    row = runs.periodic_runs(docs_table(spark, [(1, text, "en")])).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 36_002, 50_000, 1, 50_000_000)
    assert row.runs_sha256 == hashlib.sha256(b"1,36000,9000\n36002,50000,1\n").hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(["start", *period, "end", "same"]).encode()).hexdigest()
