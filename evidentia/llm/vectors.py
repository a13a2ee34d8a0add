"""Near-duplicate vectors by navigable small-world graphs, one for every shard of a label.

Equal vectors are one node. A label's nodes are dealt into shards of bounded size, every shard gets a layered
graph, and every node is looked up in every shard of its label by a walk, whatever the shard's size. A label's beams are widened
until an audit passes: the true links of some of its nodes, by all cosines, pooled over all shards. Pairs found are confirmed in double
precision; the links' components are joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import components, prepare
from evidentia.session import cut_lineage

AUDIT_LINKS = 200  # true links of a label that its audit has to see, unless all its nodes or AUDIT_MOST are audited
AUDIT_FIRST, AUDIT_MOST = 64, 4096  # nodes of a label that are audited at first and at most


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by the largest part first, so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """A layered small-world graph over unit vectors; links of a node on a layer are a list of row numbers."""

    def __init__(self, x: np.ndarray, m: int = 10, width: int = 40, seed: int = 1):
        self.x, self.m, self.width = np.ascontiguousarray(x, np.float32), m, width
        n = len(x)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 8)
        self.layers: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry, self.top = 0, -1
        self.seen, self.stamp = np.zeros(n, np.int64), 0
        for i in range(n):
            self.insert(i, int(levels[i]))

    def insert(self, i: int, level: int) -> None:
        for layer in self.layers[: level + 1]:
            layer[i] = []
        if self.top < 0:
            self.entry, self.top = i, level
            return
        q, at = self.x[i], [self.entry]
        for k in range(self.top, level, -1):
            at = [self.beam(q, at, 1, k)[0][1]]
        for k in range(min(level, self.top), -1, -1):
            found = self.beam(q, at, self.width, k)
            at = [j for _, j in found]
            most = 2 * self.m if k == 0 else self.m
            layer = self.layers[k]
            layer[i] = self.spread(found, self.m)
            for j in layer[i]:
                layer[j].append(i)
                if len(layer[j]) > most:
                    near = self.x[layer[j]] @ self.x[j]
                    layer[j] = self.spread(sorted(zip(near.tolist(), layer[j]), reverse=True), most)
        if level > self.top:
            self.entry, self.top = i, level

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first: those nearer to the centre than to any chosen one, then the nearest others."""
        if len(found) <= most:
            return [j for _, j in found]
        rows = [j for _, j in found]
        between = self.x[rows] @ self.x[rows].T
        nearest = np.full(len(rows), -2.0, np.float32)
        chosen, spare = [], []
        for a, (near, _) in enumerate(found):
            if len(chosen) < most and near > nearest[a]:
                chosen.append(a)
                np.maximum(nearest, between[a], out=nearest)
            else:
                spare.append(a)
        return [rows[a] for a in (chosen + spare)[:most]]

    def beam(self, q: np.ndarray, start: list[int], width: int, k: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first walk on layer ``k`` meets, nearest first."""
        self.stamp += 1
        seen, stamp, layer, x = self.seen, self.stamp, self.layers[k], self.x
        seen[start] = stamp
        near = (x[start] @ q).tolist()
        todo = [(-s, j) for s, j in zip(near, start)]
        best = list(zip(near, start))
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = np.array(layer[i], np.int64)
            fresh = fresh[seen[fresh] != stamp]
            if not len(fresh):
                continue
            seen[fresh] = stamp
            near = x[fresh] @ q
            if len(best) >= width:
                good = near > best[0][0]
                fresh, near = fresh[good], near[good]
            for s, j in zip(near.tolist(), fresh.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def near(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        at = [self.entry]
        for k in range(self.top, 0, -1):
            at = [self.beam(q, at, 1, k)[0][1]]
        return self.beam(q, at, width, 0)

    def pack(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat arrays: layer and row of each node entry, number of links, links."""
        rows = [(k, i, links) for k, layer in enumerate(self.layers) for i, links in layer.items()]
        head = np.array([(k, i, len(links)) for k, i, links in rows], np.int32).reshape(-1, 3)
        return head, np.array([j for _, _, links in rows for j in links], np.int32), np.array([self.entry, self.top], np.int32)

    @classmethod
    def unpack(cls, x: np.ndarray, head: np.ndarray, links: np.ndarray, entry: np.ndarray) -> Graph:
        graph = cls(x[:0])
        graph.x, graph.seen = np.ascontiguousarray(x, np.float32), np.zeros(len(x), np.int64)
        graph.entry, graph.top = int(entry[0]), int(entry[1])
        graph.layers = [{} for _ in range(graph.top + 1)]
        ends = np.cumsum(head[:, 2])
        for (k, i, n), z in zip(head.tolist(), ends.tolist()):
            graph.layers[k][i] = links[z - n : z].tolist()
        return graph


def search(graph: Graph, queries: np.ndarray, limit: float, width: int) -> np.ndarray:
    """Which nodes of the graph each query links with (queries x nodes).

    A beam that is full of links is doubled, and so is one whose walk met fewer nodes than it holds: that walk failed. Only where a beam as
    wide as the shard still misses nodes, because the graph falls apart, the query takes all cosines.
    """
    n, x = len(graph.x), graph.x.astype(np.float64)
    hits = np.zeros((len(queries), n), bool)
    for i, q in enumerate(queries.astype(np.float32)):
        beam = min(width, n)
        while True:
            found = graph.near(q, beam)
            whole = len(found) >= beam
            if whole and (beam == n or found[-1][0] < limit - 1e-3):
                hits[i, [j for s, j in found if s >= limit - 1e-3]] = True
                break
            if beam == n:
                hits[i] = x @ queries[i] >= limit - 1e-3
                break
            beam = min(2 * beam, n)
    return hits


def confirmed(hits: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """The found pairs whose cosine in double precision reaches the limit."""
    for i in np.flatnonzero(hits.any(1)):
        at = np.flatnonzero(hits[i])
        hits[i, at] = (b[at] * a[i]).sum(1) >= limit
    return hits


def groups(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the component of each row and of each column of a table of links; -1 for a column without links."""
    rows, columns = np.full(hits.shape[0], -1), np.full(hits.shape[1], -1)
    for i in range(len(rows)):
        if rows[i] < 0:
            rows[i], front = i, np.array([i])
            while len(front):
                met = np.flatnonzero(hits[front].any(0) & (columns < 0))
                columns[met] = i
                front = np.flatnonzero(hits[:, met].any(1) & (rows < 0))
                rows[front] = i
    return rows, columns


def found_links(hits: np.ndarray, ids: np.ndarray, copies: np.ndarray, ids2: np.ndarray, copies2: np.ndarray) -> pd.DataFrame:
    """``(id, links, root)`` of the rows and columns of a table of links: rows linked with, and the least id of the component."""
    rows, columns = groups(hits)
    table = pd.DataFrame({
        "id": np.concatenate([ids, ids2]), "group": np.concatenate([rows, columns]),
        "links": [int(copies2[h].sum()) for h in hits] + [int(copies[h].sum()) for h in hits.T],
    })
    table = table[table["links"] > 0]
    return table.assign(root=table.groupby("group")["id"].transform("min"))[["id", "links", "root"]]


INDEX = "label int, dim int, shard int, ids binary, copies binary, vectors binary, head binary, links binary, entry binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("id")
    x = unit(np.stack(group["embedding"].to_numpy()))
    head, links, entry = Graph(x).pack()
    row = (*group[["label", "dim", "shard"]].iloc[0], group["id"].to_numpy(np.int64).tobytes(), group["copies"].to_numpy(np.int64).tobytes(),
           x.tobytes(), head.tobytes(), links.tobytes(), entry.tobytes())
    return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])


FOUND = "label int, dim int, id bigint, links bigint, root bigint"


def _link(limit: float, width: int):
    def load(r, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
        part = lambda name, kind: np.frombuffer(getattr(r, f"{side}_{name}"), kind)
        x = part("vectors", np.float64).reshape(-1, r.dim)
        return part("ids", np.int64), part("copies", np.int64), x, Graph.unpack(x, part("head", np.int32).reshape(-1, 3), part("links", np.int32), part("entry", np.int32))

    columns = [c.split()[0] for c in FOUND.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                ids, copies, x, graph = load(r, "a")
                if r.a == r.b:
                    hits = search(graph, x, limit, width)
                    hits |= hits.T
                    np.fill_diagonal(hits, False)
                    hits = confirmed(hits, x, x, limit)
                    hits |= hits.T  # a product may round differently in the other order
                    yield found_links(hits, ids, copies, ids, copies).drop_duplicates("id").assign(label=r.label, dim=r.dim)[columns]
                else:
                    ids2, copies2, y, graph2 = load(r, "b")
                    hits = search(graph2, x, limit, width) | search(graph, y, limit, width).T
                    yield found_links(confirmed(hits, x, y, limit), ids, copies, ids2, copies2).assign(label=r.label, dim=r.dim)[columns]

    return run


def _true_links(limit: float):
    def run(key: tuple, nodes: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(asking):
            return pd.DataFrame({"label": [], "dim": [], "id": [], "links": []})
        x, y = unit(np.stack(nodes["embedding"].to_numpy())), unit(np.stack(asking["embedding"].to_numpy()))
        ids, copies = nodes["id"].to_numpy(np.int64), nodes["copies"].to_numpy(np.int64)
        near = y @ x.T >= limit - 1e-9
        links = []
        for i, own in enumerate(asking["id"].to_numpy(np.int64)):
            at = np.flatnonzero(near[i])
            at = at[((x[at] * y[i]).sum(1) >= limit) & (ids[at] != own)]
            links.append(int(copies[at].sum()))
        return pd.DataFrame({"label": key[0], "dim": key[1], "id": asking["id"], "links": links})

    return run


def audited(dealt: DataFrame, shards: DataFrame, limit: float) -> DataFrame:
    """``(label, dim, id, links)``: the true links of a sample of each label's nodes, by all cosines over all its shards.

    The sample grows with every round until the label's audit has seen ``AUDIT_LINKS`` links, all nodes or ``AUDIT_MOST`` of them.
    """
    most, seen, todo = AUDIT_FIRST, None, shards
    while True:
        part = F.lit(float(most)) / F.col("nodes")
        u = F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = dealt.join(todo.select("label", "dim", "nodes", "shards"), ["label", "dim"]).where(u < part)
        asking = chosen.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("label", "dim", "shard", "id", "embedding").toDF("a_label", "a_dim", "a_shard", "id", "embedding")
        keys = ["label", "dim", "shard"]
        found = dealt.join(todo.select("label", "dim"), ["label", "dim"]).groupBy(*keys).cogroup(asking.groupBy("a_label", "a_dim", "a_shard")).applyInPandas(_true_links(limit), "label int, dim int, id bigint, links bigint")
        known = cut_lineage(found.groupBy("label", "dim", "id").agg(F.sum("links").alias("links")))
        short = known.groupBy("label", "dim").agg(F.sum("links").alias("links"))
        more = cut_lineage(todo.join(short, ["label", "dim"], "left").where((F.coalesce("links", F.lit(0)) < AUDIT_LINKS) & (F.col("nodes") > most)).drop("links"))
        kept = known.join(more.select("label", "dim"), ["label", "dim"], "left_anti")
        if most * 4 > AUDIT_MOST or more.isEmpty():
            return known if seen is None else seen.unionByName(known)
        seen, todo, most = kept if seen is None else seen.unionByName(kept), more, most * 4


def near_vectors(vectors: DataFrame, limit: float = 0.93, shard_rows: int = 8192, recall: float = 0.98, width: int = 32) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept, recall)`` for every row of ``vectors(vec_id, embedding, label)``.

    Also ``recall``: the share of the audited true links of the row's label that was found, 1 without any; null for rows that link with nothing by rule.
    Rows link if their labels are equal and not null and the cosine is at least ``limit``. Vectors that are null, empty, zero or hold a
    null or a number that is not finite link with nothing; so do rows without a key, which have no component and are kept. Equal
    vectors of a label are linked; each row counts its copies. Repeated rows count as copies; vectors of different lengths
    never link. Other columns are not read. ``shard_rows`` bounds a shard and so what a task holds.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = cut_lineage(rows.withColumn("usable", usable))
    good = rows.where("usable")
    nodes = cut_lineage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    counted = nodes.groupBy("label", "dim").agg(F.count("*").alias("nodes"))
    shards = cut_lineage(counted.withColumn("shards", F.ceil(F.col("nodes") / F.lit(shard_rows)).cast("int")))
    dealt = cut_lineage(nodes.join(shards.drop("nodes"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).drop("shards"))
    index = cut_lineage(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, INDEX))

    truth = cut_lineage(audited(dealt, shards, limit))
    kept = ["ids", "copies", "vectors", "head", "links", "entry"]
    last = index.groupBy("label", "dim").agg(F.max("shard").alias("last"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, figures, todo = None, None, cut_lineage(index.select("label", "dim").distinct())
    while True:
        of = index.join(todo, ["label", "dim"])
        side = lambda s: of.select("label", "dim", F.col("shard").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in kept])  # noqa: B023, E731
        left = side("a").join(last, ["label", "dim"]).withColumn("b", F.explode(F.sequence("a", "last")))
        pairs = left.join(side("b"), ["label", "dim", "b"])
        prepare(spark, 4)  # a row holds one or two whole shards
        met = cut_lineage(pairs.repartition(4 * parts, "label", "dim", "a", "b").mapInPandas(_link(limit, width), FOUND))
        prepare(spark)
        got = met.groupBy("id").agg(F.sum("links").alias("got"))
        shares = truth.join(todo, ["label", "dim"]).join(got, "id", "left").groupBy("label", "dim").agg(
            F.sum(F.coalesce("got", F.lit(0))).alias("got"), F.sum("links").alias("true"))
        share = F.when(F.col("true") > 0, F.col("got") / F.col("true")).otherwise(1.0)
        shares = cut_lineage(todo.join(shares.select("label", "dim", share.alias("recall")), ["label", "dim"], "left").fillna(1.0, ["recall"]))
        low = cut_lineage(shares.where(F.col("recall") < recall).select("label", "dim")) if width < shard_rows else shares.limit(0)
        again = not low.isEmpty()
        met, shares = (df.join(low, ["label", "dim"], "left_anti") if again else df for df in (met, shares))
        found, figures = (met, shares) if found is None else (found.unionByName(met), figures.unionByName(shares))
        if not again:
            break
        todo, width = low, 2 * width
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = cut_lineage(
        nodes.join(links, "id", "left").join(labels, "id", "left").join(figures, ["label", "dim"], "left").select(
            "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("root"), "recall")
    )
    joined = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", F.col("root").alias("component_id"), "recall")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    kept_row = F.col("component_id").isNull() | (F.col("vec_id") == F.col("component_id"))
    return joined.unionByName(alone).withColumn("kept", kept_row).select("vec_id", "n_links", "component_id", "kept", "recall")
