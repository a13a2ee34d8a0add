"""Token counts and byte-level BPE against the libraries themselves."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from evidentia.llm import byte_bpe, token_counts
from evidentia.session import scratch_path
from tests.llm.cases import LONG, ODD_ROWS, docs_table, no_docs, odd_docs, random_texts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def spec():
    return byte_bpe.tokenizer_json(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_librarys():
    texts = random_texts(3000) + ["", " ", LONG]
    whole = Tokenizer.from_file(BYTE_BPE)
    expected = [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(texts, BYTE_BPE, "test") == expected


def test_counts_of_odd_rows_and_cache(spark, monkeypatch):
    cache = scratch_path(spark, "cache")
    whole = Tokenizer.from_file(BYTE_BPE)
    expected = sorted((i is None, i or 0, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in ODD_ROWS)
    read = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())
    assert read(token_counts.count_tokens(odd_docs(spark), BYTE_BPE, cache)) == expected
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, _ in ODD_ROWS})
    monkeypatch.setattr(token_counts, "_encoder", lambda *a: lambda batches: (1 / 0 for b in batches if b.num_rows))
    assert read(token_counts.count_tokens(odd_docs(spark), BYTE_BPE, cache)) == expected, "nothing is encoded again"
    assert spark.read.parquet(cache).count() == stored.count()


def test_counts_of_nothing(spark):
    assert token_counts.count_tokens(no_docs(spark), BYTE_BPE, scratch_path(spark, "cache")).count() == 0


def test_merges_follow_from_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    assert byte_bpe.last_pair(b"abc", ranks) == (b"ab", b"c")
    assert byte_bpe.last_pair(b"xyz", ranks) is None


def test_ids_are_those_of_the_ranks(spec, reference):
    texts = random_texts(3000, 1) + ["", " ", LONG]
    bpe = byte_bpe.ByteBPE(spec)
    assert bpe.encode(texts) == [reference.encode_ordinary(t) for t in texts]
    for text, (n, ids, raw) in zip(texts, byte_bpe.digests(texts, spec)):
        own = reference.encode_ordinary(text)
        assert n == len(own)
        assert ids == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert raw == hashlib.sha256(text.encode()).hexdigest()


def test_all_characters(spec, reference):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 61 == 0)]
    texts = [f"a{c} {c}b. {c}{c}" for c in letters]
    wrong = [c for c, a, b in zip(letters, byte_bpe.ByteBPE(spec).encode(texts), reference.encode_ordinary_batch(texts, num_threads=4)) if a != b]
    assert wrong == []


def test_split_characters(spec):
    bpe = byte_bpe.ByteBPE(spec)
    ids = bpe.encode(["ein \U0001f9ff zwei"])[0]
    spans = bpe.offsets(ids)
    raw = "ein \U0001f9ff zwei".encode()
    assert spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert bpe.decode(ids) == raw and bpe.decode_text(ids) == "ein \U0001f9ff zwei"
    halves = [bpe.decode(ids[:k]) + bpe.decode(ids[k:]) for k in range(len(ids))]
    assert set(halves) == {raw}
    assert "�" in bpe.decode_text([i for i in ids if not bpe.bytes_of[i].isascii()][:1])


def test_columns_and_odd_rows(spark, spec, reference):
    from pyspark.sql import functions as F

    docs = odd_docs(spark)
    coded = docs.withColumn("e", byte_bpe.encode_column(docs, spec, F.col("text")))
    back = coded.select("text", "e", byte_bpe.decode_column(docs, spec, F.col("e.ids")).alias("raw")).collect()
    for r in back:
        assert bytes(r.raw) == (r.text or "").encode() and r.e.ids == reference.encode_ordinary(r.text or "")
        assert r.e.ends == r.e.starts[1:] + ([len(r.raw)] if r.e.ids else [])
    rows = byte_bpe.encode_digests(docs, spec).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i is None, i or 0, len(reference.encode_ordinary(t or ""))) for i, t, _ in ODD_ROWS)
    assert byte_bpe.encode_digests(no_docs(spark), spec).count() == 0
    assert docs_table(spark, [(1, "a", "b")]).count() == 1


def test_tables_that_are_full_start_anew(monkeypatch):
    from evidentia.llm.pieces import Table

    monkeypatch.setattr(Table, "LIMIT", 50)
    texts = random_texts(400, 9)
    whole = Tokenizer.from_file(BYTE_BPE)
    expected = [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    got = [n for a in range(0, len(texts), 7) for n in token_counts.count_texts(texts[a : a + 7], BYTE_BPE, "full")]
    assert got == expected
