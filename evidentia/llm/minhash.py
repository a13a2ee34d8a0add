"""Near-duplicate documents by fast similarity sketching, banding and exact confirmation.

A sketch has 128 places. In round after round every shingle is hashed to one random place and leaves its hash there if it
is the smallest; a value of an earlier round is smaller than any of a later one. After 128 rounds the shingles go to the places
in turn, so that every place is filled after at most 256 rounds, and a text of many shingles needs one or two.
Texts that agree in all four places of a band share a bucket. Links are confirmed on the full sets:

1. in every bucket, the text with the smallest id against all others;
2. in buckets whose texts are still in different components, all texts of different components, block by block inside
   tasks that return no more links than texts.

Texts with equal words are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WORD_HASHES, components, mixed, prepare, text_or_empty, windows
from evidentia.session import cut_lineage

PLACES, BAND = 128, 4
BANDS = PLACES // BAND
WORDS = 5
BLOCK = 128  # texts of a bucket on each side of a block
LEAST_ESTIMATE = 0.5  # six deviations below 0.75 for 128 places: such a pair is no link
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEEDS = mixed(np.arange(1, 2 * PLACES + 1, dtype=np.uint64))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of all words where there are fewer."""
    return np.unique(windows(WORD_HASHES.of(words), min(WORDS, len(words)))) if words else np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Sketch (128 numbers) of every set; sets must not be empty."""
    out = np.full((len(sets), PLACES), np.iinfo(np.uint64).max, np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), lengths)
    for r in range(2 * PLACES):
        h = mixed(flat ^ SEEDS[r])
        place = (h & np.uint64(PLACES - 1)).astype(np.int64) if r < PLACES else np.full(len(h), r - PLACES)
        np.minimum.at(out.reshape(-1), owner * PLACES + place, (np.uint64(r) << np.uint64(56)) | (h >> np.uint64(8)))
        open_rows = (out == np.iinfo(np.uint64).max).any(1)
        if not open_rows.any():
            break
        going = open_rows[owner]
        flat, owner = flat[going], owner[going]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One number for every band of every sketch; its upper bits are the band's number."""
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND):
            keys = mixed(keys * np.uint64(31) + sketch[:, k::BAND])
    return ((np.arange(BANDS, dtype=np.uint64) << np.uint64(58)) | (keys >> np.uint64(6))).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether the intersection is at least ``per_cent`` of the union of two sorted sets."""
    if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= per_cent * (len(a) + len(b) - shared)


def signatures(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, digest, n_shingles, keys)``; digest and keys are null for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sets = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sets.append(shingles(words))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            for i, row in zip(full, band_keys(sketches([sets[i] for i in full]))):
                keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "keys"],
            )

    schema = f"doc_id {kind}, digest binary, n_shingles bigint, keys array<bigint>"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def _stars(per_cent: int):
    """Links between the leader of a group and its other texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leader = group["leader"].iloc[0]
        sets = [shingles(words_of(t)) for t in group["text"]]
        heads = [s for i, s in zip(group["id"], sets) if i == leader]
        hits = {i for i, s in zip(group["id"], sets) if i != leader and any(linked(h, s, per_cent) for h in heads)}
        return pd.DataFrame({"a": [leader] * len(hits), "b": sorted(hits)}, columns=["a", "b"])

    return run


def _blocks(per_cent: int):
    """Links between texts of different components in one block of a bucket, as few as connect what is linked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        band = int(group["key"].iloc[0]) >> 58
        ids, side = group["id"].to_numpy(), group["side"].to_numpy()
        sets = [shingles(words_of(t)) for t in group["text"]]
        sketch = sketches(sets)
        keys = band_keys(sketch)
        names = {c: n for n, c in enumerate(dict.fromkeys(group["component"]))}
        root = list(range(len(names)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        component = [names[c] for c in group["component"]]
        links = []
        right = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(ids))  # a block against itself has one side
        for i in np.flatnonzero(side == 0):
            near = (sketch[right] == sketch[i]).mean(1)
            first = (keys[right, :band] == keys[i, :band]).any(1) if band else np.zeros(len(right), bool)
            for j in right[(near >= LEAST_ESTIMATE) & ~first]:  # a pair is tested in the first band that it shares
                x, y = find(component[i]), find(component[j])
                if x != y and linked(sets[i], sets[j], per_cent):
                    links.append((ids[i], ids[j]))
                    root[x] = y
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _block_rows(mixed_rows: DataFrame) -> DataFrame:
    """Rows of buckets ``(key, id, component)`` dealt into blocks ``(key, i, j, side)``.

    The largest component of a bucket has been seen to be linked, so only the others' blocks meet all blocks.
    """
    sizes = cut_lineage(mixed_rows.groupBy("key", "component").agg(F.count("*").alias("n")))
    top = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    plan = cut_lineage(top.select("key", "top", blocks(F.col("all") - F.col("most")).alias("few"), blocks(F.col("most")).alias("many")))
    rows = mixed_rows.join(plan, "key").withColumn("minor", F.col("component") != F.col("top"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("minor"), own).otherwise(F.col("few") + own))
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    ahead = F.transform(F.sequence(F.col("own"), F.col("few") + F.col("many") - 1), lambda j: pair(F.col("own"), j, 0))
    behind = F.transform(F.sequence(F.lit(0), F.least("own", "few") - 1), lambda i: pair(i, F.col("own"), 1))
    behind = F.when(F.least("own", "few") > 0, behind)
    everywhere = F.concat(F.when(F.col("minor"), ahead).otherwise(F.slice(ahead, 1, 0)), F.coalesce(behind, F.slice(ahead, 1, 0)))
    return rows.select("key", "id", "component", F.explode(everywhere).alias("p")).select("key", "id", "component", "p.*")


def near_duplicates(docs: DataFrame, per_cent: int = 75) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest key that the text reaches by links, itself included, and ``kept`` tells whether that is its
    own. Texts without words link with nothing. Rows that share a key are one node; a row without a key links with nothing, has no
    component and is kept. Equal texts are one node, so copies of any number cost one row each. Other columns are not read. A
    pair at 0.75 exactly shares no band with probability 5e-6. The bands and the least estimate are made for 75 and more; a lower
    ``per_cent`` would lose links and is refused.
    """
    if not 75 <= per_cent <= 100:
        raise ValueError(f"per_cent is {per_cent}, not 75 to 100")
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(signatures(docs))
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = cut_lineage(known.groupBy("digest").agg(F.min("doc_id").alias("id")))
    nodes = known.join(reps.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi")
    buckets = nodes.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    leaders = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    leaders = cut_lineage(leaders.select("key", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n")))
    members = cut_lineage(buckets.join(leaders, "key"))
    close = 100 * F.least("n", "leader_n") >= per_cent * F.greatest("n", "leader_n")
    pairs = cut_lineage(members.where((F.col("id") != F.col("leader")) & close).select("leader", "id").distinct())
    involved = members.select("id").distinct()
    texts = cut_lineage(
        docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(involved.hint("shuffle_hash"), "id", "left_semi")
    )

    chunks = cut_lineage(pairs.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("chunks")))
    spread = pairs.join(chunks, "leader").select("leader", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id")
    heads = chunks.select("leader", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("id"))
    stars = cut_lineage(spread.unionByName(heads)).join(texts, "id")
    edges = cut_lineage(stars.groupBy("leader", "chunk").applyInPandas(_stars(per_cent), f"a {kind}, b {kind}"))

    labels = components(edges)
    named = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("component"))
    named = cut_lineage(named.distinct())
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    open_keys = cut_lineage(open_keys.where("low <> high AND n > 2").select("key"))  # a bucket of two has been tested whole
    blocks = cut_lineage(_block_rows(cut_lineage(named.join(open_keys, "key", "left_semi"))))
    more = blocks.join(texts, "id").groupBy("key", "i", "j").applyInPandas(_blocks(per_cent), f"a {kind}, b {kind}")
    labels = components(edges.unionByName(cut_lineage(more)))

    roots = reps.join(labels, "id", "left").select("digest", F.coalesce("component_id", "id").alias("root"))
    rows = signed.join(cut_lineage(roots), "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
