"""Quality grades by ordinal regression with cumulative links on hashed text.

One weight for every bucket of hashed features gives a text's place on a line, and ordered thresholds cut the
line into grades: P(grade > k) = sigmoid(place - threshold k). The expected grade and the probability of
reaching a wanted grade follow. Trained here, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import WORD_HASHES, Kept, bounded_ids, fold, in_fold, prepare, repeated_words, text_or_empty
from evidentia.llm.language import adam

BUCKETS = 1 << 13


def bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) % BUCKETS


def shape(word: str) -> str:
    """A word's run of kinds: X upper case, x other letters, 9 digits, and other characters as they are."""
    out: list[str] = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:6])


class WordBuckets(Kept):
    """Both buckets of a word, of the word itself in lower case and of its shape, in one number."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        value = self[word] = bucket("word " + text.lower()) * BUCKETS + bucket("shape " + shape(text))
        return value


_BUCKETS = WordBuckets()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with values: shares of words and shapes, and shares of repetition under names of their own."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    _BUCKETS.trim()
    both = np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    extra = {
        "length": np.log1p(n) / 10,
        "repeated windows": repeated_words(WORD_HASHES.of(words)) / max(1, n),
        "same word again": float((both[1:] == both[:-1]).mean()) if n > 1 else 0.0,
        "repeated lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }
    at = np.concatenate([both // BUCKETS, both % BUCKETS, np.array([bucket(f"text {k}") for k in extra])])
    values = np.concatenate([np.full(2 * n, 1 / max(1, n)), np.array(list(extra.values()))])
    return at, values


@dataclass
class OrdinalModel:
    """Weights by bucket and the ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, places: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, for places on the line."""
        return 1 / (1 + np.exp(self.thresholds[None] - places[:, None]))

    def places(self, texts: list[str]) -> np.ndarray:
        return np.array([self.weights[at] @ values for at, values in map(features, texts)])


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, odds: np.ndarray, steps: int = 400, penalty: float = 2e-5) -> OrdinalModel:
    """Largest weighted likelihood with a squared penalty on the weights; ``odds`` weighs the rows."""
    n, top = len(rows), int(grades.max())
    at = np.concatenate([a for a, _ in rows])
    values = np.concatenate([v for _, v in rows])
    lengths = np.array([len(a) for a, _ in rows])
    starts, owner = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(n), lengths)
    odds = odds / odds.sum()
    weights, cuts = np.zeros(BUCKETS), np.concatenate([[-1.0], np.zeros(top - 1)])  # first threshold, then logs of the gaps
    step = adam([weights, cuts], 0.1)
    row = np.arange(n)
    for _ in range(steps):
        thresholds = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        places = np.add.reduceat(weights[at] * values, starts)
        p = 1 / (1 + np.exp(np.clip(thresholds[None] - places[:, None], -30, 30)))
        p = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])  # P(grade >= k) for k from 0 to top + 1
        low, high = p[row, grades], p[row, grades + 1]
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        share = odds / np.maximum(low - high, 1e-9)
        g_place = -share * (slope_low - slope_high)
        g_thresholds = np.zeros(top + 2)
        np.add.at(g_thresholds, grades, share * slope_low)
        np.add.at(g_thresholds, grades + 1, -share * slope_high)
        tail = np.cumsum(g_thresholds[1 : top + 1][::-1])[::-1]  # a gap moves all thresholds after it
        g_cuts = np.concatenate([tail[:1], tail[1:] * np.exp(cuts[1:])])
        g_weights = np.bincount(at, values * g_place[owner], BUCKETS) + penalty * weights
        step([g_weights, g_cuts])
    return OrdinalModel(weights, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, rows: int = 2000) -> OrdinalModel | None:
    """A model from a bounded sample of ``ratings(doc_id, grade)``, or None where fewer than two grades are known.

    At most ``rows`` documents of every grade from 0 on are learned from, weighed back to the grades' shares; fold 0 of 5 is
    never learned from. The driver gets sparse features, at most 2 * BUCKETS numbers a document, of one row a key; of
    several grades of a key the lowest counts.
    """
    prepare(docs.sparkSession)
    known = ratings.where("doc_id IS NOT NULL AND grade >= 0").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    counts = {r.grade: r.n for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    chosen = None
    for grade in sorted(counts):
        part = bounded_ids(known.where(F.col("grade") == grade), "doc_id", rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for at, v in map(features, batch.column("text").to_pylist()):
                seen, back = np.unique(at, return_inverse=True)
                places.append(seen.astype(np.uint16).tobytes())
                values.append(np.bincount(back, v, len(seen)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "grade", "at", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    got = found.mapInArrow(encode, f"doc_id {kind}, grade int, at binary, v binary").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: (r.doc_id, r.grade, r.v))
    names = sorted({r.grade for r in got})
    if len(names) < 2:
        return None
    grades = np.array([names.index(r.grade) for r in got])
    odds = np.array([counts[r.grade] for r in got]) / np.bincount(grades)[grades]
    data = [(np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.v, np.float32).astype(float)) for r in got]
    return train(data, grades, odds)


def score_column(docs: DataFrame, model: OrdinalModel | None, grade: int = 1) -> Column:
    """Struct ``(expected_grade, tail_probability)`` of the text column; nulls without a model."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade: double, tail_probability: double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            if m is None or not len(texts):
                yield pd.DataFrame({"expected_grade": [None] * len(texts), "tail_probability": [None] * len(texts)}, dtype="float64")
                continue
            above = m.above(m.places(texts.tolist()))
            yield pd.DataFrame({"expected_grade": above.sum(1), "tail_probability": above[:, grade - 1]})

    return score(text_or_empty())


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from ``labels(doc_id, quality, toxic)``: 0 for bad quality, 1 for good but toxic, 2 for good and not known to be toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("grade IS NOT NULL")


def grade_rows(docs: DataFrame, model: OrdinalModel | None, least: float = 0.5) -> DataFrame:
    """Rows ``(doc_id, held_out, expected_grade, tail_probability, kept)`` for every row of ``docs(doc_id, text)``.

    A row is kept if P(grade >= 1) is at least ``least``, or if nothing was learned. A null text counts as empty; rows without a key
    are not held out; repeated rows keep their rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text").withColumn("s", score_column(docs, model))
    return rows.select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "s.expected_grade", "s.tail_probability",
        (F.coalesce("s.tail_probability", F.lit(1.0)) >= least).alias("kept"),
    )
