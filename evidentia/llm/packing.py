"""Packing documents into sequences by a grouping genetic algorithm on islands.

Pieces of documents are dealt into blocks of bounded size, which best fit packs. What it leaves open, the sequences with room, is dealt
into small groups that several islands search at once; after an epoch each island's best packing moves to the next island. A crossover
puts whole well-filled sequences of one packing into another, takes out the sequences that hold the same pieces, and places the pieces left
over by best fit. A second round deals what is still open into other groups. Where best fit already needs no more sequences than the
lengths do, there is nothing to search and no generation runs.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Kept, prepare, text_or_empty
from evidentia.llm.pieces import plain_word
from evidentia.session import cut_lineage

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
ALONE = 1 << 60  # sequences of pieces that fill one by themselves are numbered from here
_LOADED: dict[str, Ids] = {}


class Ids(Kept):
    """Ids by piece of text, as little-endian unsigned 32-bit numbers."""

    LIMIT = 500_000
    PART = 20_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def learn(self, pieces: list[str]) -> None:
        """Encode what is new among distinct pieces."""
        new = [p for p in pieces if p not in self]
        if self.trim(len(new)):
            new = pieces
        words = [p for p in new if plain_word(p)]
        for a in range(0, len(words), self.PART):
            self.update(zip(words[a : a + self.PART], self.together(words[a : a + self.PART])))
        others = [p for p in new if not plain_word(p)]
        for a in range(0, len(others), self.PART):
            self.update(zip(others[a : a + self.PART], self.one_by_one(others[a : a + self.PART])))

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def one_by_one(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(pieces)]

    def together(self, words: list[str]) -> list[bytes]:
        """Words of letters go through as one text; each ends with a token that has the end mark."""
        ids = np.array(self.encode([" ".join(words)])[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self.one_by_one(words)
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:z] for a, z in zip(at, at[1:])]


def id_table(spec: bytes) -> Ids:
    """This worker's table for a tokenizer."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Ids(spec.decode())
    return _LOADED[key]


def text_ids(texts: pa.Array, table: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, one after the other, and where each text's ids begin and the last's end.

    White space is dropped by the tokenizer and never part of a match, so a text may be cut at any space, and a space
    may come between a Latin letter and a full stop or comma, where a match ends anyway. The tokenizer lower-cases; ASCII
    letters are so from the start, unless a text may hold a special string. Distinct pieces are looked up once; their
    ids are then gathered for all places at which they stand.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    spaced = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])", r"\1 \2")
    lists = pc.split_pattern(spaced, " ")
    pieces = lists.flatten().dictionary_encode()
    names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    table.learn(names)
    found = list(map(table.__getitem__, names))
    flat = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    first = np.cumsum(size) - size
    places = pieces.indices.to_numpy(zero_copy_only=False)
    lengths = size[places]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    ids = flat[np.arange(ends[-1]) + np.repeat(first[places] - ends[:-1], lengths)]
    return ids, ends[lists.offsets.to_numpy()]


def by_size(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes at most, a longer text by itself."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Rows ``(uid, doc_id, piece, start, length, ids_crc32)``: every document's ids and the end id, cut at ``capacity``."""
    prepare(docs.sparkSession, 2000)
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = id_table(shared.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            keys, texts, rows = batch.column("doc_id"), batch.column("text"), []
            for low, high in by_size(texts):
                flat, at = text_ids(texts.slice(low, high - low), table)
                ids = np.insert(flat, at[1:], end_id)  # after every text
                at = at + np.arange(len(at))
                raw = ids.astype("<u4").tobytes()
                for row, (start, end) in enumerate(zip(at.tolist(), at[1:].tolist()), low):
                    for k, a in enumerate(range(start, end, capacity)):
                        z = min(a + capacity, end)
                        rows.append((uid, row, k, a - start, z - a, zlib.crc32(raw[4 * a : 4 * z])))
                        uid += 1
            u, at, k, a, n, crc = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), keys.take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def best_fit(items: np.ndarray, lengths: list[int], bins: np.ndarray, free: dict[int, int], capacity: int, count: int) -> int:
    """Put items, in their order, where the least room is left over; returns the number of bins. ``bins`` is filled in.

    ``free`` has the room of the bins that exist. Bit r of ``mask`` tells whether some bin has r places left.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in free.items():
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    for i in items.tolist():
        length = lengths[i]
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i] = b
        room -= length
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return count


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: minus the number of bins, and the sum of squared fills."""
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill * fill).sum())


def crossed(
    giver: np.ndarray, taker: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, opened: int = 2, inject: bool = True
) -> np.ndarray:
    """A packing with some of the giver's well-filled bins, the taker's bins that share nothing with them, and best fit for the rest.

    Some of the fullest bins are injected whole; bins of the taker that hold a document twice then are taken apart, and so are its ``opened``
    least filled ones. Without ``inject`` only those are.
    """
    fill, old = np.bincount(giver, lengths), np.bincount(taker, lengths)
    full = np.argsort(rng.random(len(fill)) * 0.02 * capacity - fill, kind="stable")[: max(1, int(0.7 * len(fill)))]
    share = rng.choice([0.2, 0.4, 0.6])
    chosen = np.zeros(len(fill), bool)
    if inject:
        chosen[rng.choice(full, min(len(full), max(1, int(share * len(fill)))), replace=False)] = True
    taken = chosen[giver]
    broken = np.zeros(len(old), bool)
    broken[taker[taken]] = True
    whole = np.flatnonzero(~broken)
    broken[whole[np.argsort(old[whole] + rng.random(len(whole)) * 0.05 * capacity, kind="stable")[:opened]]] = True
    stays = ~taken & ~broken[taker]
    out = np.full(len(giver), -1, np.int64)
    number = np.cumsum(chosen) - 1
    out[taken] = number[giver[taken]]
    used, again = np.unique(taker[stays], return_inverse=True)
    count = int(chosen.sum()) + len(used)
    out[stays] = int(chosen.sum()) + again
    rooms = capacity - np.bincount(out[out >= 0], lengths[out >= 0], count).astype(np.int64)
    left = np.flatnonzero(out < 0)
    left = left[np.argsort(-lengths[left], kind="stable")]
    best_fit(left, lengths.tolist(), out, dict(enumerate(rooms.tolist())), capacity, count)
    return out


def evolve(
    population: list[np.ndarray], lengths: np.ndarray, capacity: int, rng: np.random.Generator, size: int, generations: int, inject: bool = True
) -> list[np.ndarray]:
    """An island's epoch: packings, best first. What the population lacks is filled up by best fit on decreasing lengths and on disturbed ones.

    Parents are the better of two drawn at random; a child takes the place of the worst packing if it is better and like no other. Where
    the best packing has no more bins than the lengths need, no generation runs.
    """
    population = list(population)
    while len(population) < size:
        noise = 1 + (0.2 * rng.random(len(lengths)) if population else 0)
        packing = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-lengths * noise, kind="stable"), lengths.tolist(), packing, {}, capacity, 0)
        population.append(packing)
    worth = [fitness(p, lengths, capacity) for p in population]
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        if -max(worth)[0] <= least or len(population) < 2:
            break
        order = sorted(range(len(population)), key=worth.__getitem__, reverse=True)
        first, second = (int(rng.integers(len(order), size=2).min()) for _ in range(2))
        if first == second:
            second = (second + 1) % len(order)
        for a, b in ((order[first], order[second]), (order[second], order[first])):
            child = crossed(population[a], population[b] if inject else population[a], lengths, capacity, rng, inject=inject)
            value, worst = fitness(child, lengths, capacity), min(range(len(population)), key=worth.__getitem__)
            if value > worth[worst] and value not in worth:
                population[worst], worth[worst] = child, value
    order = sorted(range(len(population)), key=worth.__getitem__, reverse=True)
    return [population[i] for i in order][:size]


STATE = "round int, block bigint, island int, uids array<bigint>, lengths array<bigint>, packings array<array<bigint>>, bins bigint, fill double"


def _epoch(capacity: int, size: int, generations: int, epoch: int, seed: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                lengths = np.array(r.lengths, np.int64)
                rng = np.random.default_rng([seed, epoch, r.round, r.block, r.island])
                start = [np.array(p, np.int64) for p in r.packings]
                packings = evolve(start, lengths, capacity, rng, size, generations)
                bins, fill = fitness(packings[0], lengths, capacity)
                rows.append((r.round, r.block, r.island, r.uids, r.lengths, [p.tolist() for p in packings], -bins, fill))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    return run


def fit_blocks(items: DataFrame, capacity: int, block_rows: int) -> DataFrame:
    """Rows ``(uid, length, sequence_id)`` for ``items(uid, length)``: best fit on decreasing lengths, block by block."""
    blocks = max(1, -(-items.count() // block_rows))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid")
        lengths, bins = part["length"].to_numpy(np.int64), np.zeros(len(part), np.int64)
        best_fit(np.argsort(-lengths, kind="stable"), lengths.tolist(), bins, {}, capacity, 0)
        return pd.DataFrame({"uid": part["uid"], "length": lengths, "sequence_id": (key[0] << 20) + bins})

    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")
    return cut_lineage(items.groupBy(block).applyInPandas(run, "uid bigint, length bigint, sequence_id bigint"))


def search_groups(
    packed: DataFrame, capacity: int, number: int, group_rows: int = 512, islands: int = 4, epochs: int = 2, size: int = 12, generations: int = 40, seed: int = 17
) -> DataFrame:
    """Rows ``(uid, length, sequence_id)`` of the sequences that the genetic search may improve, packed anew in groups of about ``group_rows``.

    Whole sequences with room left are dealt into groups. Islands search each group, starting from its present packing and from best fit, and send their best
    packing on to the next island between epochs; the best island's packing holds, so no group gets worse. Groups with as few sequences as their
    lengths need, for which nothing can be gained, are left out and not returned.
    """
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < capacity).select("sequence_id")
    open_ = cut_lineage(packed.join(fills, "sequence_id"))
    groups = max(1, -(-open_.count() // group_rows))
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
    need = dealt.groupBy("block").agg(F.count_distinct("sequence_id").alias("now"), F.ceil(F.sum("length") / capacity).alias("least")).where("now > least")
    item = F.struct("uid", "length", "sequence_id")
    listed = dealt.join(need.select("block"), "block").groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    marks = F.array_sort(F.array_distinct("items.sequence_id"))
    present = F.transform("items", lambda x: (F.array_position(F.col("marks"), x.sequence_id) - 1).cast("bigint"))
    state = listed.withColumn("marks", marks).select(
        F.lit(number).alias("round"), "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths"), F.array(present).alias("packings"),
    )
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(epochs):
        state = cut_lineage(state.repartition(min(4 * parts, groups * islands), "block", "island").mapInPandas(_epoch(capacity, size, generations, epoch, seed), STATE))
        movers = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("packings")[0].alias("elite"))
        joined = state.join(movers, ["block", "island"])
        moved = F.concat(F.array("elite"), F.slice("packings", 1, size - 1))
        final, state = state, joined.select("round", "block", "island", "uids", "lengths", moved.alias("packings"))
    order = F.struct(-F.col("bins"), "fill", -F.col("island"))
    winners = final.groupBy("block").agg(F.max_by("island", order).alias("island"))
    chosen = final.join(winners, ["block", "island"]).select(
        "block", F.explode(F.arrays_zip("uids", "lengths", F.col("packings")[0].alias("bins"))).alias("x")
    )
    numbers = F.lit((number + 1) << 52) + F.shiftleft("block", 20) + F.col("x.bins")
    return cut_lineage(chosen.select(F.col("x.uids").alias("uid"), F.col("x.lengths").alias("length"), numbers.alias("sequence_id")))


def pack_lengths(items: DataFrame, capacity: int, block_rows: int = 8192, rounds: int = 2, **search) -> DataFrame:
    """Rows ``(uid, length, sequence_id)`` for ``items(uid, length)``: best fit in blocks, then rounds of genetic search on what it leaves open,
    each in other groups, so that sequences of different blocks meet."""
    packed = fit_blocks(items, capacity, block_rows)
    for number in range(rounds):
        better = search_groups(packed, capacity, number, **search)
        if better.isEmpty():
            continue
        packed = cut_lineage(packed.join(better.select("uid"), "uid", "left_anti").select("uid", "length", "sequence_id").unionByName(better))
    return packed


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, block_rows: int = 8192, rounds: int = 2
) -> DataFrame:
    """Rows ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for all of ``docs(doc_id, text)``.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, into pieces of that length and
    a last one. Pieces of full length are sequences of their own. A null text is empty, so it gives the end id alone;
    repeated rows and null keys give pieces for every row; an empty table gives no rows; other columns are not read. ``block_rows``
    bounds what a task packs; every piece is in exactly one block.
    """
    pieces = cut_lineage(cut_pieces(docs, tokenizer_path, capacity, end_id))
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    packed = pack_lengths(rest, capacity, block_rows, rounds)
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    before = lambda x, i: F.struct(
        x.uid.alias("uid"), F.aggregate(F.slice("items", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y.length).alias("offset"))
    offsets = grouped.select("sequence_id", F.explode(F.transform("items", before)).alias("x")).select("x.uid", "sequence_id", "x.offset")
    alone = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid") + F.lit(ALONE), "offset": F.lit(0).cast("bigint")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pieces.join(offsets, "uid").select(*columns).unionByName(alone.select(*columns))
