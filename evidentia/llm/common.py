"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import cut_lineage

BATCH_ROWS = 500
_SHIPPED: dict[str, str] = {}


def fold(key: str, n: int) -> Column:
    """Fold of a row: unsigned crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def in_fold(key: str, n: int, k: int) -> Column:
    """Whether the row is in fold ``k``; a row without a key is in none."""
    return F.coalesce(fold(key, n) == k, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """What the Python parts ask of a session.

    Few rows to an Arrow batch, so that a batch of very long texts still fits a worker; and this package on
    the executors, so that workers keep its tables from task to task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if _SHIPPED.get("to") != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED["to"] = context.applicationId


def bounded_ids(labels: DataFrame, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of the key: a repeatable sample of bounded size."""
    return labels.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit)


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(id, component_id)`` for every id on an edge ``(a, b)``: the smallest id it reaches.

    Every round takes the smallest label among the neighbours and then the label of that label, so a
    chain halves. Minima are added up before the shuffle, and the joins have exchanges on both sides,
    so Spark can split the rows of an id with very many links. Edges of null ids count for nothing; an
    empty table gives an empty table.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = cut_lineage(
        edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
    )
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("c")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        hooked = cut_lineage(
            labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        )
        labels = cut_lineage(
            hooked.join(hooked.select(F.col("id").alias("c"), F.col("c").alias("root")), "c").select("id", F.col("root").alias("c"), (F.col("root") != F.col("old")).alias("changed"))
        )
        if labels.where("changed").isEmpty():
            return labels.select("id", F.col("c").alias("component_id"))
        labels = labels.select("id", "c")


class Kept(dict):
    """A worker's table of results by key, bounded together with all others: a worker outlives the stage that filled one.

    ``trim`` goes before a batch. It drops the other tables when all together have grown beyond ``LIMIT`` entries, and its
    own when that alone has, which it tells. Tables that are filled for the same batch are ``mates`` and leave each other alone.
    """

    LIMIT = 300_000
    ALL: list[Kept] = []

    def __init__(self) -> None:
        super().__init__()
        self.mates: list[Kept] = []
        self.ALL.append(self)

    def trim(self, coming: int = 0) -> bool:
        if sum(map(len, self.ALL)) + coming > self.LIMIT:
            for other in self.ALL:
                if other is not self and not any(other is m for m in self.mates):
                    other.clear()
            if len(self) + coming > self.LIMIT:
                self.clear()
                return True
        return False


class WordHashes(Kept):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        self.trim()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASHES = WordHashes()
ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying loses nothing


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if count > 0 else 0):
            out = out * ODD + hashes[k : k + count]
    return mixed(out)


def repeated_words(hashes: np.ndarray, n: int = 8) -> int:
    """Words that lie in a run of ``n`` words which the text holds twice or more, the first included."""
    runs = windows(hashes, n)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[: len(runs)] += twice
    edge[n : n + len(runs)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())
