"""Exact nearest neighbours of places in any number of columns, by a partition tree.

Cells that hold too many places are split along their widest column at quantiles, level by level, as grouped aggregates and joins.
A cell of bounded size then is one row of packed arrays, cut further into leaves at exact medians. Boxes over all columns
tell which cells can hold a nearer neighbour: leaves first search their own cell and then ask only cells within reach. Cells next to
each other are a group: a task holds the cells of one group that the leaves of another one ask, so a leaf moves once for each group.
Where boxes of many columns prune little, a matrix product bounds all distances from below, and only places within reach of the bound
are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.running import running_sums
from evidentia.session import cut_lineage

CELL_BYTES = 4 << 20  # of a cell's coordinates; a task holds one cell and some asking leaves
CELL_PLACES = 8192
LEAF = 128  # places compared at once
FAN = 16  # children of a split
ASKS = 64  # leaves of further rows that ask a cell in one task
GROUP_BYTES = 32 << 20  # of a group's coordinates; a task holds two groups at most
GROUP_PLACES = 65_536
GROUPS = 16  # at least, if there are as many cells: tasks for all cores
WIDE = 8  # columns from which on distances are bounded by a matrix product first
SCREEN = 32  # leaves in one product
FEW = 50_000  # nodes of a level that are broadcast; beyond, no node holds a large share of the rows
SLACK = 1 + 1e-9

BLOCK = "cell string, ids binary, x binary, w binary, sizes binary"
PAIR = "id bigint, copies bigint, nb bigint, nb_w bigint, dist double"
ASK = (
    "cell string, q bigint, lo array<double>, hi array<double>, reach double, ids binary, x binary, copies binary, reaches binary, "
    "pair array<struct<id: bigint, copies: bigint, nb: bigint, nb_w: bigint, dist: double>>"
)


@dataclass
class _Kernels:
    leaves: Callable
    packed: Callable
    unpacked: Callable
    opened: Callable
    search: Callable
    ask: Callable
    schema: pa.Schema


def _kernels() -> _Kernels:
    """Array steps of the search. Made here so that they travel to the tasks by value and the executors need no copy of this package."""
    pair_type = pa.struct([("id", pa.int64()), ("copies", pa.int64()), ("nb", pa.int64()), ("nb_w", pa.int64()), ("dist", pa.float64())])
    ends_type = pa.list_(pa.float64())
    wide, screens = WIDE, SCREEN
    blob_fields = [(n, pa.binary()) for n in ("ids", "x", "copies", "reaches")]
    schema = pa.schema([("cell", pa.string()), ("q", pa.int64()), ("lo", ends_type), ("hi", ends_type), ("reach", pa.float64()), *blob_fields, ("pair", pa.list_(pair_type))])

    def leaves(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of places in which leaves of at most ``most`` lie together, and the leaves' sizes."""
        order, todo, ends = np.arange(len(x)), [(0, len(x))], []
        while todo:
            a, b = todo.pop()
            part = x[order[a:b]]
            width = part.max(0) - part.min(0)
            if b - a <= most or not width.max() > 0:
                ends.append(b)
                continue
            v = part[:, int(width.argmax())]
            middle = np.partition(v, len(v) // 2)[len(v) // 2]
            left = v < middle if middle > v.min() else v <= middle
            order[a:b] = np.concatenate([order[a:b][left], order[a:b][~left]])
            cut = a + int(left.sum())
            todo += [(a, cut), (cut, b)]
        return order, np.diff(np.sort(np.array([0, *ends])))

    def packed(x: np.ndarray) -> bytes:
        """Coordinates as bytes, in single precision where that holds them all."""
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        return (single if np.array_equal(single, x) else np.ascontiguousarray(x)).tobytes()

    def unpacked(data: bytes, n: int, d: int) -> np.ndarray:
        return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d).astype(np.float64)

    def opened(rows: list[dict], d: int) -> dict:
        """Ids, places, weights, cells, starts and boxes of the leaves of packed cells."""
        ids, w = (np.concatenate([np.frombuffer(row[c], np.int64) for row in rows]) for c in ("ids", "w"))
        x = np.concatenate([unpacked(row["x"], len(row["ids"]) // 8, d) for row in rows])
        sizes = [np.frombuffer(row["sizes"], np.int64) for row in rows]
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        cells = np.repeat(np.array([row["cell"] for row in rows], object), [len(n) for n in sizes])
        return {"cells": cells, "ids": ids, "x": x, "w": w, "starts": starts, "lo": np.minimum.reduceat(x, starts[:-1]), "hi": np.maximum.reduceat(x, starts[:-1]), "screens": {}}

    def search(x: np.ndarray, reach: np.ndarray, own: np.ndarray | None, block: dict, k: int, home: str | None = None):
        """For places ``x``, what lies in the cells within ``reach`` and within the k-th distance: rows, neighbours' places in the cells, distances, and the
        smaller reaches. ``own`` are the ids of places that the cells hold as well and that are no neighbours of themselves.
        Leaves of the cell ``home`` are left out."""
        gap = np.sqrt((np.maximum(0, np.maximum(block["lo"] - x.max(0), x.min(0) - block["hi"])) ** 2).sum(1))
        gap[block["cells"] == home] = np.inf
        return (by_screens if x.shape[1] >= wide else by_leaves)(x, reach.copy(), own, block, k, gap)

    def by_leaves(x: np.ndarray, r: np.ndarray, own: np.ndarray | None, block: dict, k: int, gap: np.ndarray):
        ids, y, starts, lo, hi = (block[c] for c in ("ids", "x", "starts", "lo", "hi"))
        best = np.full((len(x), k), np.inf)
        kept = []
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] > r.max() * 1.000000001 or gap[leaf] == np.inf:
                break
            apart = np.sqrt((np.maximum(0, np.maximum(lo[leaf] - x, x - hi[leaf])) ** 2).sum(1))
            rows = np.flatnonzero(apart <= r * 1.000000001)
            if not len(rows):
                continue
            a, b = starts[leaf], starts[leaf + 1]
            dist = np.zeros((len(rows), b - a))
            for j in range(x.shape[1]):  # column by column, so that equal distances are equal in every bit
                delta = x[rows, j][:, None] - y[a:b, j][None, :]
                dist += delta * delta
            dist = np.sqrt(dist)
            if own is not None:
                dist[own[rows][:, None] == ids[a:b][None, :]] = np.inf
            kept.append((rows, a, dist))
            best[rows] = np.partition(np.concatenate([best[rows], dist], 1), k - 1, axis=1)[:, :k]
            r[rows] = np.minimum(r[rows], best[rows, k - 1])
        row, at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for rows, a, dist in kept:
            i, j = np.nonzero((dist <= r[rows][:, None]) & (dist < np.inf))
            row.append(rows[i])
            at.append(a + j)
            far.append(dist[i, j])
        return np.concatenate(row), np.concatenate(at), np.concatenate(far), r

    def screen(block: dict, first: int, last: int, kind: type) -> tuple:
        """Places of leaves ``first`` to ``last`` as a factor of the product: centre, scale, factor, largest square and the bound's relative slack."""
        key = (first, kind)
        if key not in block["screens"]:
            y = block["x"][block["starts"][first] : block["starts"][last]]
            centre = (y.min(0) / 2 + y.max(0) / 2)
            y = y - centre
            scale = float(np.abs(y).max()) or 1.0
            y = (y / scale).astype(kind)
            slack = 8 * (y.shape[1] + 8) * float(np.finfo(kind).eps)  # above the rounding of the centred places, their squares and the product
            square = (y.astype(np.float64) ** 2).sum(1)
            factor = np.ascontiguousarray(np.concatenate([-2 * y, (square * (1 - slack)).astype(kind)[:, None]], 1).T)
            block["screens"][key] = centre, scale, factor, float(square.max()), slack
        return block["screens"][key]

    def near(x: np.ndarray, r: np.ndarray, made: tuple, columns: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns whose squared distance may be at most that of ``r`` and of the row's place ``most``. What can't be told stays in."""
        centre, scale, factor, largest, slack = made
        kind = factor.dtype.type
        factor = factor if columns is None else factor[:, columns]
        with np.errstate(all="ignore"):
            ours = ((x - centre) / scale).astype(kind)
            square = (ours.astype(np.float64) ** 2).sum(1)
            low = np.concatenate([ours, np.ones((len(x), 1), kind)], 1) @ factor
            limit = (r / scale) ** 2 * (1 + 16 * float(np.finfo(kind).eps)) - square * (1 - slack) + 1e-30
            open_ = np.flatnonzero(~np.isfinite(r))
            if len(open_) and low.shape[1] >= most:
                kth = np.partition(low[open_], most - 1, axis=1)[:, most - 1].astype(np.float64)
                limit[open_] = kth + 2 * slack * (square[open_] + largest) + 1e-30
            limit = np.nextafter(limit.astype(kind), kind(np.inf))
            return np.divmod(np.flatnonzero(~(low > limit[:, None])), low.shape[1])

    def by_screens(x: np.ndarray, r: np.ndarray, own: np.ndarray | None, block: dict, k: int, gap: np.ndarray):
        ids, y, starts = block["ids"], block["x"], block["starts"]
        row, at, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        firsts = np.arange(0, len(gap), screens)
        most = k if own is None else k + 1
        nearest = np.minimum.reduceat(gap, firsts)
        for s in np.argsort(nearest, kind="stable"):
            reach = r.max() * 1.000000001
            if nearest[s] > reach or nearest[s] == np.inf:
                break
            first, last = firsts[s], min(firsts[s] + screens, len(gap))
            asked = first + np.flatnonzero((gap[first:last] <= reach) & (gap[first:last] < np.inf))
            columns = None
            if 2 * len(asked) < last - first or np.isinf(gap[first:last]).any():
                columns = np.concatenate([np.arange(starts[leaf], starts[leaf + 1]) for leaf in asked]) - starts[first]
            i, j = near(x, r, screen(block, first, last, np.float32), columns, most)
            if len(i) > len(x) * max(4 * most, (starts[last] - starts[first]) // 16):  # places too close to each other, or too far, for single precision
                i, j = near(x, r, screen(block, first, last, np.float64), columns, most)
            j = starts[first] + (j if columns is None else columns[j])
            if own is not None:
                other = own[i] != ids[j]
                i, j = i[other], j[other]
            dist = np.zeros(len(i))
            for c in range(x.shape[1]):  # column by column, so that equal distances are equal in every bit
                delta = x[i, c] - y[j, c]
                dist += delta * delta
            dist = np.sqrt(dist)
            here = (dist <= r[i]) & (dist < np.inf)
            if not here.any():
                continue
            row, at, far = np.concatenate([row, i[here]]), np.concatenate([at, j[here]]), np.concatenate([far, dist[here]])
            order = np.lexsort((far, row))
            row, at, far = row[order], at[order], far[order]
            begin = np.searchsorted(row, np.arange(len(x)))
            full = np.flatnonzero(np.diff(np.append(begin, len(row))) >= k)
            r[full] = np.minimum(r[full], far[begin[full] + k - 1])
            here = far <= r[row]
            row, at, far = row[here], at[here], far[here]
        return row, at, far, r

    def ask(cell: str, q: int, ids: np.ndarray, x: np.ndarray, copies: np.ndarray, own: np.ndarray | None, block: dict, k: int) -> pa.RecordBatch:
        """One asking leaf with what its own cell holds."""
        row, at, far, reach = search(x, np.full(len(x), np.inf), own, block, k)
        fields = [pa.array(a) for a in (ids[row], copies[row], block["ids"][at], block["w"][at], far)]
        pairs = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), pa.StructArray.from_arrays(fields, ["id", "copies", "nb", "nb_w", "dist"]))
        blobs = [pa.array([a], pa.binary()) for a in (ids.tobytes(), packed(x), copies.tobytes(), reach.tobytes())]
        ends = [pa.array([e.tolist()], ends_type) for e in (x.min(0), x.max(0))]
        return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([q], pa.int64()), *ends, pa.array([float(reach.max())]), *blobs, pairs], schema=schema)

    return _Kernels(leaves, packed, unpacked, opened, search, ask, schema)


def _box_gap(lo: str, hi: str, node_lo: str, node_hi: str) -> Column:
    """Distance between two boxes."""
    gap = F.zip_with(F.zip_with(node_lo, hi, lambda a, b: a - b), F.zip_with(lo, node_hi, lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g))


def _far_corner(lo: str, hi: str, node_lo: str, node_hi: str) -> Column:
    """The greatest distance between places of two boxes."""
    span = F.zip_with(F.zip_with(hi, node_lo, lambda a, b: F.abs(a - b)), F.zip_with(node_hi, lo, lambda a, b: F.abs(a - b)), lambda a, b: F.greatest(a, b))
    return F.sqrt(F.aggregate(span, F.lit(0.0), lambda s, g: s + g * g))


def _few(nodes: DataFrame) -> DataFrame:
    """A level's nodes, to be broadcast if they are few."""
    return F.broadcast(nodes) if nodes.count() <= FEW else nodes


@dataclass
class PartitionTree:
    """``nodes(node, parent, depth, size, cell, lo, hi)`` and the packed cells ``blocks``; both stay distributed."""

    d: int
    nodes: DataFrame
    blocks: DataFrame
    depth: int

    @classmethod
    def build(cls, places: DataFrame, d: int, cell_places: int | None = None, fan: int = FAN, leaf: int = LEAF) -> PartitionTree:
        """The tree of ``places(id, loc, w)``, all different.

        Quantiles come from a mergeable sketch: where exactly a cell is split changes the time, never the result. A value that holds a
        large share of a cell gets a child of its own, so every split makes progress, whatever the columns hold.
        """
        most = cell_places or max(2, min(CELL_PLACES, CELL_BYTES // (8 * d)))
        probs = [(i + 1) / fan for i in range(fan - 1)]
        active = places.select("id", "loc", "w", F.lit("").alias("node"))
        levels, settled, depth = [], [], 0
        while True:
            ends = [f(F.col("loc")[j]).alias(f"{n}{j}") for j in range(d) for n, f in (("l", F.min), ("h", F.max))]
            boxes = active.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *ends).select(
                "node", "size", F.array(*[f"l{j}" for j in range(d)]).alias("lo"), F.array(*[f"h{j}" for j in range(d)]).alias("hi"))
            width = F.zip_with("hi", "lo", lambda h, l: h - l)
            level = cut_lineage(boxes.select("*", (F.array_position(width, F.array_max(width)) - 1).cast("int").alias("axis")))
            crowded = level.where(F.col("size") > most)
            parent = F.regexp_replace("node", r"\.?[^.]*$", "")
            levels.append(level.select("node", F.when(F.col("node") != "", parent).alias("parent"), F.lit(depth).alias("depth"), "size", (F.col("size") <= most).alias("cell"), "lo", "hi"))
            if crowded.isEmpty():
                settled.append(active)
                break
            settled.append(active.join(_few(crowded.select("node")), "node", "left_anti"))
            marked = active.join(_few(crowded.select("node", "axis")), "node")
            cuts = marked.groupBy("node", "axis").agg(F.percentile_approx(F.element_at("loc", F.col("axis") + 1), probs, 10_000).alias("q"))
            heavy = F.filter("at", lambda t: (F.size(F.filter("q", lambda c: c == t)) > 1) | (t >= F.element_at("hi", F.col("axis") + 1)))
            split = cut_lineage(cuts.join(crowded.select("node", "hi"), "node").withColumn("at", F.array_distinct("q")).select("node", "axis", "at", heavy.alias("heavy")))
            x = F.element_at("loc", F.col("axis") + 1)
            child = F.size(F.filter("at", lambda t: t < x)) + F.size(F.filter("heavy", lambda t: t <= x))
            path = F.concat_ws(".", F.when(F.col("node") != "", F.col("node")), child.cast("string"))
            active = cut_lineage(active.join(_few(split), "node").select("id", "loc", "w", path.alias("node")))
            depth += 1
        nodes, rows = levels[0], settled[0]
        for more in levels[1:]:
            nodes = nodes.unionByName(more)
        for more in settled[1:]:
            rows = rows.unionByName(more)
        kernels = _kernels()
        make, packed = kernels.leaves, kernels.packed

        def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(part["loc"].to_numpy())
            order, sizes = make(x, leaf)
            blob = lambda a: np.ascontiguousarray(a[order]).tobytes()
            row = (key[0], blob(part["id"].to_numpy(np.int64)), packed(x[order]), blob(part["w"].to_numpy(np.int64)), sizes.astype(np.int64).tobytes())
            return pd.DataFrame([row], columns=["cell", "ids", "x", "w", "sizes"])

        return cls(d, cut_lineage(nodes), cut_lineage(rows.groupBy("node").applyInPandas(pack, BLOCK)), depth)

    def neighbours(self, k: int) -> DataFrame:
        """``(id, copies, nb, nb_w, dist)``: for every place of at most k rows the other places within the distance of its k-th, ties included, and at times
        some beyond. ``copies`` are the place's other rows."""
        d, kernels = self.d, _kernels()
        opened, ask = kernels.opened, kernels.ask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = opened([row], d)
                    ids, x, w, starts = (block[c] for c in ("ids", "x", "w", "starts"))
                    for q, (a, b) in enumerate(zip(starts, starts[1:])):
                        live = a + np.flatnonzero(w[a:b] <= k)
                        if len(live):
                            yield ask(row["cell"], q, ids[live], x[live], w[live] - 1, ids[live], block, k)

        asks = self.blocks.repartition(self._parts(), "cell").mapInArrow(run, ASK)
        return self._completed(cut_lineage(asks) if self.depth else asks, k)

    def nearest(self, fresh: DataFrame, k: int) -> DataFrame:
        """The same for places ``fresh(id, loc)`` that are not in the tree."""
        d, kernels = self.d, _kernels()
        leaves, opened, ask, schema = kernels.leaves, kernels.opened, kernels.ask, kernels.schema
        front = fresh.select("id", "loc", F.lit("").alias("node"))
        homes = []
        for level in range(self.depth):  # down to the child whose box is nearest
            children = self.nodes.where(F.col("depth") == level + 1).select(F.col("parent").alias("node"), F.col("node").alias("child"), F.col("cell").alias("last"), "lo", "hi")
            met = front.join(_few(children), "node").withColumn("gap", _box_gap("loc", "loc", "lo", "hi"))
            best = F.min_by(F.struct("child", "last"), F.struct("gap", "child"))
            met = cut_lineage(met.groupBy("id").agg(F.any_value("loc").alias("loc"), best.alias("to")).select("id", "loc", F.col("to.child").alias("node"), F.col("to.last").alias("last")))
            homes.append(met.where("last").drop("last"))
            front = met.where("NOT last").drop("last")
        rows = homes[0] if homes else front
        for more in homes[1:]:
            rows = rows.unionByName(more)
        rows = rows.withColumnRenamed("node", "cell")

        def run(key: tuple, asking: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if not len(asking):
                return pa.Table.from_batches([], schema).to_pandas()
            block = opened(cells.to_dict("records"), d)
            x, ids = np.stack(asking["loc"].to_numpy()), asking["id"].to_numpy(np.int64)
            order, sizes = leaves(x, LEAF)
            ends, out = np.cumsum(sizes), []
            for b, n in zip(ends, sizes):
                at = order[b - n : b]
                out.append(ask(key[0], int(ids[at].min()), ids[at], x[at], np.zeros(n, np.int64), None, block, k))
            return pa.Table.from_batches(out, schema).to_pandas()

        dealt, cells = self._dealt(rows, F.xxhash64("id"), ASKS * LEAF)
        asks = dealt.groupBy("cell", "chunk").cogroup(cells.groupBy("cell", "chunk")).applyInPandas(run, ASK)
        return self._completed(cut_lineage(asks) if self.depth else asks, k)

    def state(self) -> tuple[dict, dict[str, DataFrame]]:
        return {"d": self.d, "depth": self.depth}, {"nodes": self.nodes, "blocks": self.blocks}

    @classmethod
    def from_state(cls, state: dict, tables: dict[str, DataFrame]) -> PartitionTree:
        return cls(state["d"], tables["nodes"], tables["blocks"], state["depth"])

    def _parts(self) -> int:
        return 4 * int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def _dealt(self, asking: DataFrame, mark: Column, most: int) -> tuple[DataFrame, DataFrame]:
        """Rows that ask a ``cell`` in chunks of about ``most``, and the packed cells, once for each chunk: no cell gathers all that ask it."""
        chunks = cut_lineage(asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("chunks")))
        dealt = asking.join(_few(chunks), "cell").withColumn("chunk", F.pmod(mark, F.col("chunks").cast("bigint")).cast("int")).drop("chunks")
        cells = self.blocks.join(chunks, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return dealt, cells

    def _completed(self, asks: DataFrame, k: int) -> DataFrame:
        """Pairs found in the own cells and those in all other cells within reach. ``asks`` are read once where the tree is a single cell."""
        found = asks.select(F.explode("pair").alias("p")).select("p.*")
        if not self.depth:
            return found
        d, kernels = self.d, _kernels()
        opened, search, unpacked = kernels.opened, kernels.search, kernels.unpacked
        # a cell of few places knows no k-th distance: the parent's box holds more than k places
        heads = asks.select("cell", "q", "lo", "hi", "reach")
        known = self.nodes.where("cell")
        parents = self.nodes.select(F.col("node").alias("parent"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("size").alias("psize"))
        homes = known.select(F.col("node").alias("cell"), "parent").join(parents, "parent")
        bounded = F.when(F.col("reach") < F.lit(float("inf")), F.col("reach")).when(F.col("psize") > k, _far_corner("lo", "hi", "plo", "phi")).otherwise(F.lit(float("inf")))
        front = heads.join(_few(homes), "cell").select("cell", "q", "lo", "hi", (bounded * F.lit(SLACK)).alias("reach"), F.lit("").alias("node"))
        asked = []
        for level in range(self.depth):
            children = self.nodes.where(F.col("depth") == level + 1).select(
                F.col("parent").alias("node"), F.col("node").alias("child"), F.col("cell").alias("last"), F.col("lo").alias("nlo"), F.col("hi").alias("nhi"))
            # the boxes of a leaf are needed until it has come to a cell
            ends = [F.when(~F.col("last"), F.col(c)).alias(c) for c in ("lo", "hi")]
            met = cut_lineage(front.join(_few(children), "node").where(_box_gap("lo", "hi", "nlo", "nhi") <= F.col("reach")).select("cell", "q", *ends, "reach", "child", "last"))
            asked.append(met.where(F.col("last") & (F.col("child") != F.col("cell"))).select(F.col("child").alias("target"), "cell", "q", F.col("reach").alias("bound")))
            front = met.where("NOT last").select("cell", "q", "lo", "hi", "reach", F.col("child").alias("node"))
        wanted = asked[0]
        for more in asked[1:]:
            wanted = wanted.unionByName(more)
        groups = self._groups()
        of_cell, of_target = (_few(groups.select(F.col("cell").alias(c), F.col("group").alias(g))) for c, g in (("cell", "from"), ("target", "to")))
        wanted = cut_lineage(wanted.join(of_cell, "cell").join(of_target, "target"))
        asking = wanted.groupBy("to", "from", "cell", "q").agg(F.max("bound").alias("bound"))
        rows = asking.join(asks.select("cell", "q", "ids", "x", "copies", "reaches"), ["cell", "q"]).select("to", "from", F.col("cell").alias("home"), "bound", F.col("ids").alias("a_ids"), F.col("x").alias("a_x"), "copies", "reaches")
        cells = wanted.select(F.col("to").alias("to"), F.col("from").alias("from"), F.col("target").alias("cell")).distinct().join(self.blocks, "cell")

        def run(key: tuple, asking: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            block, out = opened(cells.to_dict("records"), d), []
            for r in asking.itertuples():
                ids, copies = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.copies, np.int64)
                reach = np.minimum(np.frombuffer(r.reaches, np.float64), r.bound)
                row, at, far, _ = search(unpacked(r.a_x, len(ids), d), reach, None, block, k, r.home)
                out.append(pd.DataFrame({"id": ids[row], "copies": copies[row], "nb": block["ids"][at], "nb_w": block["w"][at], "dist": far}))
            return pd.concat(out, ignore_index=True)

        return found.unionByName(rows.groupBy("to", "from").cogroup(cells.groupBy("to", "from")).applyInPandas(run, PAIR))

    def _groups(self) -> DataFrame:
        """``(cell, group)``: cells that follow each other in the tree, up to the bounds of a group and one cell more."""
        cells = self.nodes.where("cell").select(F.col("node").alias("cell"), "size")
        total = self.nodes.where("depth = 0").first()["size"]
        most = max(1, min(GROUP_PLACES, GROUP_BYTES // (8 * self.d), total // GROUPS))
        upto = running_sums(cells, [], ["cell"], {"upto": F.col("size")})
        return cut_lineage(upto.select("cell", F.floor((F.col("upto") - F.col("size")) / F.lit(most)).cast("int").alias("group")))
