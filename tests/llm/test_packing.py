"""Packing: ids as the library gives them, whole documents, room for every piece, and few sequences."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import packing
from tests.llm.cases import LONG, ODD_ROWS, docs_table, no_docs, odd_docs, random_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as f:
        return packing.id_table(f.read())


def test_ids_are_the_librarys(table):
    texts = random_texts(3000, 2) + ["", LONG]
    whole = Tokenizer.from_file(PATH)
    expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["skipped", *texts])[1:]
    ids, at = packing.text_ids(column, table)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == expected
    runs = list(packing.by_size(column, 1000))
    assert [i for low, high in runs for i in range(low, high)] == list(range(len(texts))) and len(runs) > 5
    assert list(packing.by_size(column[:0])) == []


def fill_is_right(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= capacity
    return at


def test_odd_rows(spark):
    rows = packing.pack_documents(odd_docs(spark), PATH).collect()
    fill_is_right(rows, 2048)
    whole = Tokenizer.from_file(PATH)
    expected = []
    for i, t, _ in ODD_ROWS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i is None, i or 0, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    assert packing.pack_documents(no_docs(spark), PATH).count() == 0


def test_many_blocks(spark):
    rng = np.random.default_rng(4)
    rows = packing.pack_documents(docs_table(spark, [(i, "x " * int(n), "en") for i, n in enumerate(rng.integers(0, 60, 600))]), PATH, capacity=64, block_rows=100).collect()
    at = fill_is_right(rows, 64)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert len(at) <= 1.02 * sum(r.length for r in rows) / 64 + 6


def test_crossing_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 300)
    first = packing.evolve([], lengths, 100, rng, 3, 0)
    child = packing.crossed(first[0], first[1], lengths, 100, rng)
    assert child.min() >= 0 and np.bincount(child, lengths).max() <= 100
    best = packing.evolve(first, lengths, 100, rng, 3, 20)
    assert packing.fitness(best[0], lengths, 100) >= packing.fitness(first[0], lengths, 100)
    assert -packing.fitness(best[0], lengths, 100)[0] <= -(-lengths.sum() // 100) + 2


def islands(lengths, seed, inject=True, migrate=True):
    """Four islands of three epochs on one group, without Spark."""
    made = [[] for _ in range(4)]
    for epoch in range(3):
        made = [packing.evolve(p, lengths, 2048, np.random.default_rng([seed, epoch, i]), 12, 40, inject) for i, p in enumerate(made)]
        made = [[made[i - 1][0], *p[:11]] if migrate else p for i, p in enumerate(made)]
    return np.array(max(packing.fitness(p[0], lengths, 2048) for p in made))


def test_islands_beat_best_fit_and_need_crossover_and_migration():
    """Documents of 400 to 1,200 tokens, which best fit packs badly."""
    fit, whole, plain, apart = (np.zeros(2) for _ in range(4))
    for seed in range(8):
        lengths = np.random.default_rng(seed).integers(400, 1200, 300)
        fit += packing.fitness(packing.evolve([], lengths, 2048, np.random.default_rng(0), 1, 0)[0], lengths, 2048)
        whole += islands(lengths, seed)
        plain += islands(lengths, seed, inject=False)
        apart += islands(lengths, seed, migrate=False)
    assert -whole[0] <= -fit[0] - 8  # a sequence less in every group
    assert -whole[0] < -apart[0] < -plain[0] <= -fit[0]
    assert whole[1] > apart[1] > plain[1]


def test_search_of_a_table_beats_best_fit(spark):
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(400, 1200, 1500))], "uid bigint, length bigint")
    count = lambda df: df.select("sequence_id").distinct().count()
    plain, packed = packing.fit_blocks(items, 2048, 500), packing.pack_lengths(items, 2048, 500, group_rows=250)
    assert sorted(map(tuple, packed.select("uid", "length").collect())) == sorted(map(tuple, items.collect()))
    assert max(r[0] for r in packed.groupBy("sequence_id").sum("length").select("sum(length)").collect()) <= 2048
    assert count(packed) <= count(plain) - 6
    even = spark.createDataFrame([(i, 1024) for i in range(40)], "uid bigint, length bigint")
    assert packing.search_groups(packing.fit_blocks(even, 2048, 500), 2048, 0).isEmpty()
    odd = spark.createDataFrame([(i, 1000) for i in range(41)], "uid bigint, length bigint")
    assert packing.search_groups(packing.fit_blocks(odd, 2048, 500), 2048, 0).isEmpty()  # needs 21 and has 21


def test_best_fit_takes_the_tightest_room():
    bins = np.full(3, -1)
    assert packing.best_fit(np.array([0, 1, 2]), [5, 9, 4], bins, {0: 6, 1: 5}, 10, 2) == 3
    assert bins.tolist() == [1, 2, 0]
