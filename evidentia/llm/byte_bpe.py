"""Byte-level BPE from a file of ranks, encoded by the tokenizers library and decoded by the reversed byte table.

A rank file lists tokens in the order in which they were learned: always the adjacent pair whose
union has the lowest rank is merged. The library wants the pairs themselves. The pair that forms a token
is what the same rule leaves of the token's bytes just before its last step: inside a longer text the
bytes of a token that comes about are merged in that order, whatever stands around them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, text_or_empty
from evidentia.llm.pieces import Table, cut, pair

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_LOADED: dict[str, tuple] = {}


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks: a base64 token and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts from which the ranks form a token, or None where they don't lead to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        if parts[best] + parts[best + 1] not in ranks:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(path: str, pattern: str) -> str:
    """A tokenizer of the library, as JSON, that splits by ``pattern`` and merges by the ranks of a file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    as_text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (pair := last_pair(token, ranks)):
            merges.append((as_text[pair[0]], as_text[pair[1]]))
    vocab = {as_text[token]: rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


class ByteBPE:
    """Encoder and decoder over one tokenizer."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = {i: bytes(byte[c] for c in token) for token, i in vocab.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; a character that is split over ids comes together again."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that form no character, as at a cut inside one, become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, ids: Iterable[int]) -> list[tuple[int, int]]:
        """Start and end of every token in the text's UTF-8 bytes."""
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(self.bytes_of[i])))
            at = out[-1][1]
        return out


def load(spec: str) -> tuple[ByteBPE, Table, Table]:
    """This worker's encoder with its tables of pieces: ids as text, their number, and the decoded bytes."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        bpe = ByteBPE(spec)

        def encode(texts: list[str]) -> list[tuple[str, int, bytes]]:
            return [(",".join(map(str, ids)), len(ids), bpe.decode(ids)) for ids in bpe.encode(texts)]

        def join(a: tuple[str, int, bytes], b: tuple[str, int, bytes]) -> tuple[str, int, bytes]:
            return f"{a[0]},{b[0]}", a[1] + b[1], a[2] + b[2]

        _LOADED[key] = bpe, *pair(encode, join)
    return _LOADED[key]


def digests(texts: list[str], spec: str) -> Iterator[tuple[int, str, str]]:
    """Number of tokens and digests of the ids and of the decoded bytes, text by text."""
    _, inner, first = load(spec)
    cuts = [cut(t) for t in texts]
    inner.learn(rest for _, rest in cuts)
    first.learn([[p for p, _ in cuts]])
    for head, rest in cuts:
        found = [first[head], *map(inner.__getitem__, rest)]
        ids, counts, raw = zip(*found)
        listed = ",".join(filter(None, ids))
        yield sum(counts), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()



def encode_column(docs: DataFrame, spec: str, text: Column) -> Column:
    """Struct ``(ids, starts, ends)`` of a text column: ids with their byte offsets."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("struct<ids: array<int>, starts: array<bigint>, ends: array<bigint>>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        bpe = load(shared.value)[0]
        ids = bpe.encode(texts.tolist())
        spans = [bpe.offsets(x) for x in ids]
        return pd.DataFrame({"ids": ids, "starts": [[a for a, _ in s] for s in spans], "ends": [[b for _, b in s] for s in spans]})

    return encode(F.coalesce(text, F.lit("")))


def decode_column(docs: DataFrame, spec: str, ids: Column) -> Column:
    """Bytes of a column of ids; a null list is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("binary")
    def decode(lists: pd.Series) -> pd.Series:
        bpe = load(shared.value)[0]
        return pd.Series([bpe.decode([] if x is None else x) for x in lists])

    return decode(ids)


def encode_digests(docs: DataFrame, spec: str) -> DataFrame:
    """Rows ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one for every row of ``docs(doc_id, text)``.

    ``spec`` comes from ``tokenizer_json`` and is sent to the executors once. A null text is empty: no ids,
    and the digests of nothing. Repeated rows and null keys keep their rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            n, ids, raw = [], [], []
            for row in digests(batch.column("text").to_pylist(), shared.value):
                for to, value in zip((n, ids, raw), row):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
