"""Token counts through a cache of digests.

A text's SHA-256 is joined to the counts that are stored for the tokenizer's digest; only distinct
texts without a stored count are encoded, and their counts are appended to the store.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import prepare, text_or_empty
from evidentia.llm.pieces import Table, cut, pair
from evidentia.session import cut_lineage, scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHE = "version string, digest string, n_tokens bigint"
_LOADED: dict[str, tuple] = {}


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of one hold for no other."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + version("tokenizers").encode()).hexdigest()


def _count_tables(path: str, key: str) -> tuple[Table, Table]:
    """This worker's tables of piece counts: of pieces after a space, and of pieces that start a text."""
    if key not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def lengths(texts: list[str]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        _LOADED[key] = pair(lengths, int.__add__)
    return _LOADED[key]


def count_texts(texts: list[str], path: str, key: str) -> list[int]:
    """Token counts of whole texts, as the library gives them."""
    inner, first = _count_tables(path, key)
    cuts = [cut(t) for t in texts]
    inner.learn(rest for _, rest in cuts)
    first.learn([[p for p, _ in cuts]])
    count = inner.__getitem__
    return [first[p] + sum(map(count, rest)) for p, rest in cuts]


def _encoder(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column("text").to_pylist(), path, key)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_tokens, over_limit)``, one for every row of ``docs(doc_id, text)``.

    ``cache_path`` is a Parquet folder of ``(version, digest, n_tokens)`` that all executors reach; it is
    made where it is missing. A null text is empty (0 tokens); repeated rows and null keys keep their
    rows; other columns of ``docs`` are not read. The vocabulary file must be at ``tokenizer_path`` on
    every machine. Works for byte-level tokenizers whose split pattern takes a space only at the start
    of a match.
    """
    spark = docs.sparkSession
    prepare(spark)
    key = tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.sha2("text", 256))
    keyed = cut_lineage(texts.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")))

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == key).select("digest", "n_tokens")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("row")
    misses = keyed.groupBy("digest").agg(one).join(stored, "digest", "left_anti").select("digest", "row.doc_id")
    chosen = texts.alias("t").join(
        misses.alias("m").hint("shuffle_hash"),
        F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.digest") == F.col("m.digest")), "left_semi",
    )
    counted = chosen.select("digest", "text").mapInArrow(_encoder(tokenizer_path, key), "digest string, n_tokens bigint")
    counted.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")).select(
        F.lit(key).alias("version"), "digest", "n_tokens"
    ).write.mode("append").parquet(cache_path)

    stored = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == key)
    stored = stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # two runs may have stored the same text
    return keyed.join(cut_lineage(stored), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def fresh_cache(docs: DataFrame) -> str:
    """A folder for a cache that lives as long as the session's shared folder."""
    return scratch_path(docs.sparkSession, "token-counts")
