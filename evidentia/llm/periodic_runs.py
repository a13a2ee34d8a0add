"""Periodic runs of words, found by block convolution.

A run of period q with at least three periods holds, for B the power of two with B <= q < 2B, an aligned block of B words
that occurs again q words later. So at every dyadic scale B each block is slid over the following window and the sum of
squared differences is taken for all distances at once, by a number-theoretic transform in exact whole numbers: a sum of
zero is an occurrence without a mismatch. Its distance is a period to try; the stretch is extended word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare

SHORTEST = 24  # words of a run
PERIODS = 3  # of a run
BASE = 8  # the smallest scale; takes all distances below 2 * BASE
FIELDS = ((2013265921, 31), (1811939329, 13), (469762049, 3))  # primes 15*2^27+1, 27*2^26+1, 7*2^26+1 and a generator of each
CHUNK_WORDS = 200_000
SLICE = 1 << 17

RESULT = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


@lru_cache(maxsize=64)
def _roots(prime: int, generator: int, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the root of unity for every half size, of it and of its inverse: ``size/2, size/4, ..., 1``."""
    out = []
    for base in (pow(generator, (prime - 1) // size, prime), pow(pow(generator, (prime - 1) // size, prime), prime - 2, prime)):
        powers = np.ones(size // 2, np.uint64)
        filled = 1
        while filled < size // 2:
            step = pow(base, filled, prime)
            powers[filled : 2 * filled] = powers[:filled] * np.uint64(step) % np.uint64(prime)
            filled *= 2
        out.append([powers[:: size // 2 // h].copy() for h in _halves(size)])
    return out[0], out[1]


def _halves(size: int) -> list[int]:
    return [size >> k for k in range(1, size.bit_length())]


@lru_cache(maxsize=32)
def _negated(size: int) -> np.ndarray:
    """Where the frequency -k lies for every place of a transform, whose places are in bit-reversed order."""
    place = np.zeros(size, np.int64)
    for bit in range(size.bit_length() - 1):
        place = (place << 1) | ((np.arange(size) >> bit) & 1)
    out = np.empty(size, np.int64)
    out[place] = place[(size - np.arange(size)) % size]
    return out


def _mod(x: np.ndarray, prime: np.uint64) -> np.ndarray:
    return x - x // prime * prime


def transform(x: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order of frequencies."""
    size, p = x.shape[1], np.uint64(field[0])
    a = x.astype(np.uint64)
    for h, w in zip(_halves(size), _roots(*field, size)[0]):
        view = a.reshape(len(a), -1, 2, h)
        low, high = view[:, :, 0, :].copy(), view[:, :, 1, :]
        total = low + high
        view[:, :, 1, :] = _mod((low + (p - high)) * w, p)
        view[:, :, 0, :] = np.where(total >= p, total - p, total)
    return a


def inverse(x: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    """What ``transform`` came from."""
    size, p = x.shape[1], np.uint64(field[0])
    a = x.copy()
    for h, w in zip(reversed(_halves(size)), reversed(_roots(*field, size)[1])):
        view = a.reshape(len(a), -1, 2, h)
        low, turned = view[:, :, 0, :].copy(), _mod(view[:, :, 1, :] * w, p)
        total, rest = low + turned, low + (p - turned)
        view[:, :, 0, :] = np.where(total >= p, total - p, total)
        view[:, :, 1, :] = np.where(rest >= p, rest - p, rest)
    return _mod(a * np.uint64(pow(size, field[0] - 2, field[0])), p)


def zero_mismatches(x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``(s, d)`` where the aligned block of ``b`` codes at ``s`` equals the ``b`` codes at ``s + d``, ``b <= d < 2b`` (``0 < d < 2b`` at
    the smallest scale).

    The codes are whole numbers from 0. As many prime fields are used as hold the largest sum of squared differences, so a sum that is
    zero in all is zero.
    """
    n = len(x)
    bound, room, fields = b * max(int(x.max(initial=0)), 1) ** 2, 1, []
    for field in FIELDS:
        if room <= bound:
            fields.append(field)
            room *= field[0]
    if room <= bound:
        raise ValueError(f"{b} codes of up to {int(x.max())} are beyond the fields of the transform")
    count = -(-n // b)
    padded = np.full((count + 2) * b, -1, np.int64)
    padded[:n] = x
    inside = np.where(padded < 0, 0, padded)
    squares = np.concatenate([[0], np.cumsum(inside * inside)])
    sign = np.ones(2 * b, bool)
    sign[b:] = False  # odd frequencies, which the shift by half a transform turns around
    found_s, found_d = [], []
    step = max(SLICE // b, 1)
    for j in range(0, count, step):
        last = min(j + step, count)
        blocks = inside[j * b : (last + 2) * b].reshape(-1, b)
        starts = np.arange(j, last) * b
        own = squares[starts + b] - squares[starts]
        rounds = [1, 0] if b == BASE else [1]
        hits = [np.ones((last - j, b), bool) for _ in rounds]
        for field in fields:
            p = np.uint64(field[0])
            flat = np.zeros((len(blocks), 2 * b), np.uint64)
            flat[:, :b] = blocks
            f = transform(flat, field)
            turned = f[: last - j][:, _negated(2 * b)]
            for k, hit in zip(rounds, hits):
                one, two = f[k : k + last - j], f[k + 1 : k + 1 + last - j]
                window = _mod(one + np.where(sign, two, p - two), p)
                shared = inverse(_mod(turned * window, p), field)[:, :b].astype(np.int64)
                at = starts[:, None] + k * b + np.arange(b)
                apart = own[:, None] + (squares[at + b] - squares[at]) - 2 * shared
                hit &= apart % field[0] == 0
        for k, hit in zip(rounds, hits):
            if k == 0:
                hit[:, 0] = False
            row, lag = np.nonzero(hit)
            found_s.append(starts[row])
            found_d.append(k * b + lag)
    s, d = np.concatenate(found_s), np.concatenate(found_d)
    fits = s + d + b <= n
    return s[fits], d[fits]


def _stretches(s: np.ndarray, d: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, end, distance)`` of neighbouring blocks that recur at the same distance."""
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + b)
    first = np.flatnonzero(new)
    last = np.append(first, len(s))[1:] - 1
    return s[first], s[last] + b, d[first]


def _reach(x: np.ndarray, part: np.ndarray, at: np.ndarray, d: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``step``, equal those ``d`` later in the same part; fewer than ``most``."""
    out = np.zeros(len(at), np.int64)
    home = part[np.clip(at - step, 0, len(x) - 1)]
    for i in range(0, len(at), max(SLICE // most, 1)):
        rows = slice(i, i + max(SLICE // most, 1))
        left = at[rows, None] + step * np.arange(most)
        right = left + d[rows, None]
        legal = (left >= 0) & (right < len(x))
        left, right = np.clip(left, 0, len(x) - 1), np.clip(right, 0, len(x) - 1)
        same = legal & (x[left] == x[right]) & (part[left] == home[rows, None]) & (part[right] == home[rows, None])
        out[rows] = np.where(same.all(1), most, np.argmin(same, 1))
    return out


def _primitive(x: np.ndarray, left: int, end: int, d: int) -> bool:
    """Whether no proper divisor of ``d`` is a period of the words from ``left`` to ``end``."""
    rest, f = d, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            q = d // f
            if np.array_equal(x[left : end - q], x[left + q : end]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _parts(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, part numbers and codes within the part of the words that a run can hold.

    A run holds each of its words at least three times, so a word that its part holds less often ends the part, and parts shorter than a
    run go; again until nothing changes.
    """
    place, part = np.arange(len(doc)), doc.astype(np.int64)
    while True:
        key, _ = pd.factorize(part * (int(code.max(initial=0)) + 1) + code)
        keep = np.bincount(key)[key] >= PERIODS if len(key) else np.zeros(0, bool)
        edge = np.ones(len(part), bool)
        edge[1:] = (part[1:] != part[:-1]) | ~keep[1:] | ~keep[:-1]
        number = np.cumsum(edge) - 1
        long = np.bincount(number, weights=keep)[number] >= SHORTEST if len(number) else keep
        stay = keep & long
        done = stay.all()
        place, part, code = place[stay], number[stay], code[stay]
        if done:
            break
    if not len(place):
        return place, part, code
    part = pd.factorize(part)[0]
    pairs, key = np.unique(part * (int(code.max()) + 1) + code, return_inverse=True)
    first = np.searchsorted(pairs // (int(code.max()) + 1), np.arange(part[-1] + 1))
    return place, part, key - first[part]


def find_runs(doc: np.ndarray, code: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs ``(start, length, smallest period)`` in the words of several texts, by start and period.

    ``doc`` numbers the texts in order, ``code`` the words: equal words of a text have equal codes. Starts count over all words.
    """
    place, part, x = _parts(doc, code)
    runs: list[tuple[int, int, int]] = []
    b = BASE
    while len(x):
        stay = np.bincount(part)[part] >= max(SHORTEST, PERIODS * b)
        place, part, x = place[stay], pd.factorize(part[stay])[0], x[stay]
        if not len(x):
            break
        s, d = zero_mismatches(x, b)
        same = part[s] == part[s + d + b - 1]
        left, end, d = _stretches(s[same], d[same], b)
        # stretches inside a run whose period divides the distance are that run; those that stay too short to be one go as well
        live = end - left + 2 * (b - 1) + d >= np.maximum(SHORTEST, PERIODS * d)
        for start, length, q in runs:
            live &= ~((place[left] >= start) & (place[end - 1] + d < start + length) & (d % q == 0))
        left, end, d = left[live], end[live], d[live]
        left = left - _reach(x, part, left - 1, d, -1, b)
        end = end + _reach(x, part, end, d, 1, b)
        long = end - left + d >= np.maximum(SHORTEST, PERIODS * d)
        for i, e, q in zip(left[long].tolist(), (end + d)[long].tolist(), d[long].tolist()):
            if _primitive(x, i, e, q):
                runs.append((int(place[i]), e - i, q))
        b *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at every place: a tenth of the texts, by the checksum of their id, repeat a stretch from some place on."""
    places = np.arange(n)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _digest(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    collapsed = b" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept)])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def _judge(texts: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
    """Result rows of several texts ``(doc_id, words)``, whose words go through the search together."""
    sizes = np.array([len(words) for _, words in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    code = pd.factorize(np.array([w for _, words in texts for w in words], object))[0].astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in find_runs(doc, code):
        i = int(doc[start])
        found[i].append((start - int(firsts[i]), length, q))
    return [_digest(key, words, runs) for (key, words), runs in zip(texts, found)]


def _run(rehearse: bool):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        for batch in batches:
            waiting, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if rehearse:
                    words = [words[i] for i in planted(key, len(words)).tolist()]
                waiting.append((key, words))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in _judge(waiting)], schema)
                    waiting, held = [], 0
            if waiting:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in _judge(waiting)], schema)

    return rows


def periodic_runs(docs: DataFrame, rehearse: bool = False) -> DataFrame:
    """One row of ``docs(doc_id, text)`` each: its runs of words, counted and digested, and the text without their repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3q)`` words
    that no neighbour extends keeping period q; runs of different periods may overlap. ``start, length, period, exponent_milli`` are
    those of the run with the greatest length/period (ties: the smallest start, then period), null without a run. The collapsed text
    keeps the first period of every run. With ``rehearse`` a tenth of the texts, by the checksum of ``doc_id``, first have their words
    replaced from some place on by a repeated stretch.

    A null or empty text has no words; a null ``doc_id`` stays null and its text as it is. Repeated rows give repeated results, an empty
    table an empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(rehearse), RESULT)
