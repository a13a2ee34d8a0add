"""Whitening of vectors: principal components by pivoted Cholesky and one-sided Jacobi rotations.

Sums and the centred scatter are added up by Spark in parts of one dimension squared; the factorisation of that matrix is the only
step outside a task. Entries are fixed-point whole numbers, so sums, centres and squared deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare
from evidentia.session import cut_lineage

STEPS, SHIFT = 64, 1_000_000  # x = floor(STEPS * c) + SHIFT
LARGEST = float(1 << 40)  # of an entry; a row with a larger one has no fixed-point form and counts as not finite
LONG = (1 << 63) - 1
BATCH_ROWS = 2000
SUMS = "n bigint, part array<double>"
RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``(vec_id, x)`` with ``x`` the fixed-point entries. Rows whose vector is null or empty, holds an entry that is null, not finite
    or beyond ``LARGEST``, or is not of the most frequent length (of equally frequent ones the greatest) are left out."""
    entries = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), entries.alias("embedding")).where(F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * STEPS).cast("bigint") + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return rows.where(F.size("x") == (lengths["dim"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _totals(rows: DataFrame, width: int, values: Callable[[np.ndarray], np.ndarray]) -> list[float]:
    """Sums over all rows of the columns of ``values(x)``, in double precision: a partial sum a task, then one small aggregate."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for batch in batches:
            if len(batch):
                total += values(_matrix(batch.column(0)))
                n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "part"])

    parts = rows.select("x").mapInArrow(partial, SUMS)
    added = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return [r["v"] for r in added]


def pivoted_cholesky(v: np.ndarray, tolerance: float = 1e-14) -> np.ndarray:
    """``L`` with ``v = L @ L.T``, a column for every pivot: the greatest diagonal entry left. Rows keep the order of ``v``, so ``L`` is triangular up
    to the order of its rows. Stops where no entry is left beyond ``tolerance`` times the greatest of all."""
    d = len(v)
    left, factor = np.diag(v).astype(float).copy(), np.zeros((d, d))
    done = np.zeros(d, bool)
    limit = tolerance * left.max(initial=0.0)
    for k in range(d):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if left[p] <= limit:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[done] = 0.0
        column[p] = np.sqrt(left[p])
        factor[:, k] = column
        left -= column * column
        done[p] = True
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of ``factor @ factor.T`` by rotating pairs of columns until all are orthogonal: squared
    lengths of the columns and the columns at length 1. The largest entry of a vector is positive.

    A sweep meets every pair once, in rounds of disjoint pairs that are turned together.
    """
    w, count = factor.copy(), factor.shape[1]
    tolerance = np.finfo(float).eps * np.sqrt(len(factor))
    ring = list(range(count + count % 2))  # one place stays empty for an odd number
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(i, j) for i, j in zip(ring[:half], reversed(ring[half:])) if max(i, j) < count]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) > tolerance * np.sqrt(aa * bb)
            if not off.any():
                continue
            turned = True
            i, j, a, b = i[off], j[off], a[:, off], b[:, off]
            z = (bb[off] - aa[off]) / (2 * ab[off])
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.sqrt(1 + t * t)
            w[:, i], w[:, j] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    values = (w * w).sum(0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], w[:, order] / np.sqrt(values[order])
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row of ``vectors(vec_id, embedding)``.

    Every entry c is taken as ``x = floor(64 c) + 1000000``. Components are unit eigenvectors of the covariance of all x-vectors, by falling
    eigenvalue e; ``whitened`` is the centred vector's part along the component over sqrt(e), ``explained`` is e over the trace, ``deviation`` the exact sum
    of ``(n x - S)^2`` (null beyond a long), ``identity_error`` the largest absolute entry of the covariance of all ``whitened`` less the identity.

    Only as many components are returned as the covariance has rank, so none for a single row, equal rows or an empty table. See ``usable`` for
    rows that are left out. Repeated rows count and are returned each, keys may be null; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark, BATCH_ROWS)
    rows = cut_lineage(usable(vectors))
    sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    if not sums:
        return spark.createDataFrame([], RESULT)
    n, total, dim = sums[0]["n"], np.array([r["s"] for r in sums], np.int64), len(sums)
    widest = max(max(n * r["hi"] - r["s"], r["s"] - n * r["lo"]) for r in sums)
    safe = n * max(max(abs(r["hi"]), abs(r["lo"])) for r in sums) <= LONG

    def apart(x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact."""
        if safe:
            return n * x - total
        return n * x.astype(object) - total.astype(object)

    def centred(x: np.ndarray) -> np.ndarray:
        return apart(x).astype(np.float64) / n

    def scatter(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return (c.T @ c).ravel()

    v = np.array(_totals(rows, dim * dim, scatter)).reshape(dim, dim) / n
    values, axes = jacobi(pivoted_cholesky((v + v.T) / 2))
    trace, count = float(np.trace(v)), min(components, len(values))
    if not count:
        return spark.createDataFrame([], RESULT)
    turn = axes[:, :count] / np.sqrt(values[:count])
    explained = values[:count] / trace
    middle = np.array(_totals(rows, count, lambda x: (centred(x) @ turn).sum(0))) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ turn - middle
        return (w.T @ w).ravel()

    unit = np.array(_totals(rows, count * count, spread)).reshape(count, count) / n
    error = float(np.abs(unit - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d = apart(_matrix(batch.column(1)))
            w = (d.astype(np.float64) / n) @ turn
            if widest * widest * dim <= LONG:
                deviation = pa.array((d * d).sum(1))
            else:
                exact = [sum(int(e) ** 2 for e in row) for row in d]
                deviation = pa.array([e if e <= LONG else None for e in exact], pa.int64())
            row = np.repeat(np.arange(len(batch)), count)
            k = len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(batch))), pa.array(np.full(k, n)),
                 deviation.take(pa.array(row)), pa.array(w.ravel()), pa.array(np.tile(explained, len(batch))), pa.array(np.full(k, error))],
                [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(project, RESULT)
