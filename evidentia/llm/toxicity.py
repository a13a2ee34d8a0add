"""Toxicity by a convolutional network over hashed words.

A word's embedding is two rows, one by a hash of the word and one by a hash of its first four letters,
so that inflected forms share a row and a rare word that shares one row with another rarely shares both.
Filters of several widths run over the words, each keeps its largest answer in the text, and a logistic
layer weighs them. Trained here, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.quantiles import order_statistics
from evidentia.llm.common import Kept, bounded_ids, fold, in_fold, prepare, text_or_empty
from evidentia.llm.language import adam
from evidentia.session import cut_lineage

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
PAD = len(WIDTHS)  # empty places after a text, so that no filter spans two
UNTOUCHED = np.float32(1e-4)  # first value of the sums of squared gradients
WORD = re.compile(r"[^\W_]+")


class Codes(Kept):
    """Both bucket numbers of a word, in one number."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest
        value = self[word] = h(word.encode("utf-8", "replace")) % BUCKETS * BUCKETS + h("^" + word[:4]) % BUCKETS
        return value


_CODES = Codes()


def codes_of(text: str) -> np.ndarray:
    """Bucket numbers of a text's words, lower-cased runs of letters and digits."""
    words = WORD.findall(text.lower())
    _CODES.trim()
    return np.fromiter(map(_CODES.__getitem__, words), np.uint32, len(words))


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows and start rows (BUCKETS: none) of texts one after the other, and where each begins."""
    lengths = np.array([len(t) + PAD for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = int(lengths.sum())
    whole, first = np.full(total + PAD, BUCKETS, np.int64), np.full(total + PAD, BUCKETS, np.int64)
    for at, t in zip(starts, texts):
        whole[at : at + len(t)] = t >> np.uint32(16)
        first[at : at + len(t)] = t & np.uint32(0xFFFF)
    return whole, first, starts


@dataclass
class WordNet:
    """Embeddings by word and by word start (the last row is empty), filters, biases, the logistic layer, and thresholds."""

    by_word: np.ndarray
    by_start: np.ndarray
    filters: list[np.ndarray]  # width, 2 d, f
    biases: list[np.ndarray]
    weights: np.ndarray
    intercept: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def start(cls, d: int = 8, f: int = 8, seed: int = 5) -> WordNet:
        rng = np.random.default_rng(seed)
        rows = [rng.normal(0, 0.05, (BUCKETS + 1, d)).astype(np.float32) for _ in range(2)]
        for r in rows:
            r[BUCKETS] = 0
        filters = [rng.normal(0, 1 / np.sqrt(2 * d * w), (w, 2 * d, f)).astype(np.float32) for w in WIDTHS]
        return cls(*rows, filters, [np.zeros(f, np.float32) for _ in WIDTHS],
                   np.ones(f * len(WIDTHS), np.float32), np.full(1, -1, np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.biases, self.weights, self.intercept]

    def learn(self, texts: list[np.ndarray], target: np.ndarray, step, squares: list[np.ndarray], rate: float) -> None:
        """One step of descent on the mean log-loss of some texts."""
        whole, first, starts = joined(texts)
        x = np.hstack([self.by_word[whole], self.by_start[first]])
        ends = starts + [len(t) for t in texts]
        pooled, places = [], []
        for k, b in zip(self.filters, self.biases):
            w, _, f = k.shape
            answers = sum(x[j : len(x) - PAD + j] @ k[j] for j in range(w)) + b
            at = np.array([a + answers[a : max(z, a + 1)].argmax(0) for a, z in zip(starts, ends)])  # n, f
            places.append(at)
            pooled.append(answers[at, np.arange(f)])
        raw = np.hstack(pooled)
        hidden = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-(hidden @ self.weights + self.intercept)))
        error = (p - target) / len(texts)
        back = error[:, None] * self.weights * (raw > 0)
        g_filters, g_biases, rows, g_rows = [], [], [], []
        for i, (k, at) in enumerate(zip(self.filters, places)):
            w, _, f = k.shape
            g = back[:, i * f : (i + 1) * f].astype(np.float32)
            g_filter = np.empty_like(k)
            for j in range(w):
                g_filter[j] = np.einsum("nfd,nf->df", x[at + j], g)
                rows.append((at + j).ravel())
                g_rows.append((g[:, :, None] * k[j].T[None]).reshape(-1, k.shape[1]))
            g_filters.append(g_filter)
            g_biases.append(g.sum(0))
        step([*g_filters, *g_biases, (hidden.T @ error).astype(np.float32), np.array([error.sum()], np.float32)])
        np.maximum(self.weights, 0, out=self.weights)  # a clean word is no excuse for a toxic one
        rows, g_rows = np.concatenate(rows), np.vstack(g_rows)
        d = self.by_word.shape[1]
        for table, square, codes, part in ((self.by_word, squares[0], whole, slice(0, d)), (self.by_start, squares[1], first, slice(d, 2 * d))):
            touched, back_to = np.unique(codes[rows], return_inverse=True)
            g = np.zeros((len(touched), d), np.float32)
            np.add.at(g, back_to, g_rows[:, part])
            square[touched] += g * g
            table[touched] -= rate * g / (np.sqrt(square[touched]) + 1e-6)
            table[BUCKETS] = 0

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Answers of every filter row to every embedding row, so that scoring only looks up and adds."""
        d = self.by_word.shape[1]
        return (
            np.hstack([self.by_word @ k[j, :d] for k in self.filters for j in range(len(k))]),
            np.hstack([self.by_start @ k[j, d:] for k in self.filters for j in range(len(k))]),
        )

    def scores(self, texts: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray], span: int = 20_000) -> np.ndarray:
        """Probability of label 1 for every text; ``span`` words at a time."""
        pooled = np.zeros((len(texts), len(self.weights)), np.float32)
        part, size = [], 0
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), span):
                piece = t[max(0, a - PAD) : a + span]
                if part and size + len(piece) > span:
                    self.pool(part, tables, pooled)
                    part, size = [], 0
                part.append((i, piece))
                size += len(piece) + PAD
        if part:
            self.pool(part, tables, pooled)
        return 1 / (1 + np.exp(-(pooled @ self.weights + self.intercept).astype(np.float64)))

    def pool(self, part: list[tuple[int, np.ndarray]], tables: tuple[np.ndarray, np.ndarray], into: np.ndarray) -> None:
        """Largest answers of some pieces, merged into those of their texts."""
        whole, first, starts = joined([t for _, t in part])
        answers = tables[0].take(whole, 0)
        answers += tables[1].take(first, 0)
        n, at, columns = len(whole) - PAD, 0, []
        ends = np.maximum(starts + [len(t) for _, t in part], starts + 1)  # an empty text has one place
        edges = np.stack([starts, ends], 1).ravel()
        for k, b in zip(self.filters, self.biases):
            w, _, f = k.shape
            total = answers[:n, at : at + f]
            for j in range(1, w):
                total = total + answers[j : n + j, at + j * f : at + (j + 1) * f]
            columns.append(np.maximum.reduceat(total, edges, 0)[::2] + b)
            at += w * f
        np.maximum.at(into, [i for i, _ in part], np.hstack(columns))


def train(texts: list[np.ndarray], target: np.ndarray, epochs: int = 8, batch: int = 32, seed: int = 2) -> WordNet:
    net = WordNet.start()
    step = adam(net.dense(), 0.01)
    squares = [np.full_like(net.by_word, UNTOUCHED), np.full_like(net.by_start, UNTOUCHED)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            net.learn([texts[i] for i in chosen], target[chosen].astype(np.float32), step, squares, 0.1)
    for table, square in zip((net.by_word, net.by_start), squares):
        table[(square <= UNTOUCHED).all(1)] = 0  # rows that never decided anything
    return net


def threshold(score: float) -> float:
    """The lowest threshold above a score that still lies between 0.2 and 0.8."""
    return float(min(0.8, max(0.2, np.nextafter(score, 1))))


def calibrated(rows: list[tuple[str, int, float]], most: float = 0.01, least: int = 20) -> dict[str, float]:
    """Thresholds by language from ``(lang, label, score)``: the lowest that flags at most ``most`` of the clean rows.

    Languages with fewer than ``least`` clean rows keep 0.5; a threshold stays between 0.2 and 0.8.
    """
    out = {}
    for lang in {lang for lang, _, _ in rows}:
        clean = sorted((s for l, y, s in rows if l == lang and y == 0), reverse=True)
        if lang is not None and len(clean) >= least:
            out[lang] = threshold(clean[int(most * len(clean))])
    return out


def calibrated_table(clean: DataFrame, most: float = 0.01, least: int = 20, together: int = 32) -> dict[str, float]:
    """What ``calibrated`` gives, for the clean rows ``(lang, score)`` of a table of any size; ``together`` languages a scan."""
    counts = clean.where("lang IS NOT NULL").groupBy("lang").count().where(F.col("count") >= least).collect()
    sizes = sorted((r["lang"], r["count"]) for r in counts)
    out = {}
    for a in range(0, len(sizes), together):
        part = {f"s{i}": (lang, n) for i, (lang, n) in enumerate(sizes[a : a + together])}
        columns = clean.select(*[F.when(F.col("lang") == lang, F.col("score")).alias(c) for c, (lang, _) in part.items()])
        targets = {c: {n - 1 - int(most * n)} for c, (_, n) in part.items()}
        found = order_statistics(columns, targets, {c: n for c, (_, n) in part.items()})
        out |= {part[c][0]: threshold(score) for (c, _), score in found.items()}
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, words: int = 5000) -> WordNet:
    """A network from a bounded sample of labelled documents, with thresholds from all clean ones of a fold.

    At most ``rows`` toxic and ``rows`` clean documents of folds 2 to 4 of 5 train it; documents of more than ``words`` words are
    not learned from. Every clean document of fold 1, of any length, counts for its language's threshold; fold 0 is
    used for neither. The driver gets bucket numbers, four bytes a word, of one row a key; a key with several labels counts as
    toxic if one says so. Without any toxic and clean document all scores stay near 0.27.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    train_rows = known.where(fold("doc_id", 5) >= 2)
    chosen = bounded_ids(train_rows.where("y = 1"), "doc_id", rows).unionByName(bounded_ids(train_rows.where("y = 0"), "doc_id", rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [codes_of(t) for t in batch.column("text").to_pylist()]
            data = [c.tobytes() if len(c) <= words else None for c in coded]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "y")] + [pa.array(data, pa.binary())], ["doc_id", "y", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    coded = found.mapInArrow(encode, f"doc_id {kind}, y int, codes binary").where("codes IS NOT NULL")
    got = coded.dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: (r.doc_id, r.codes))
    if len({r.y for r in got}) < 2:
        return WordNet.start()
    net = train([np.frombuffer(r.codes, np.uint32) for r in got], np.array([r.y for r in got]))
    net.thresholds = calibrated_table(clean_scores(docs, known, net))
    return net


def clean_scores(docs: DataFrame, known: DataFrame, net: WordNet) -> DataFrame:
    """Rows ``(lang, score)`` of every document of fold 1 that ``known(doc_id, y)`` calls clean.

    Texts are scored where they lie and only scores are shuffled to their labels.
    """
    held = docs.where(in_fold("doc_id", 5, 1))
    scores = held.select("doc_id", F.col("lang").cast("string").alias("lang"), score_column(docs, net).alias("score"))
    return cut_lineage(scores.join(known.where((F.col("y") == 0) & in_fold("doc_id", 5, 1)), "doc_id", "left_semi").select("lang", "score"))


def score_column(docs: DataFrame, net: WordNet) -> Column:
    """Score of the text column, 0 to 1; a null text counts as empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        tables = model.projected()
        for texts in parts:
            yield pd.Series(model.scores([codes_of(t) for t in texts], tables) if len(texts) else [], dtype="float64")

    return score(text_or_empty())


def threshold_column(net: WordNet) -> Column:
    """The threshold of a row's language, 0.5 where there is none."""
    if not net.thresholds:
        return F.lit(0.5)
    pairs = [F.lit(x) for k, v in sorted(net.thresholds.items()) for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang").cast("string")), F.lit(0.5))


def score_rows(docs: DataFrame, net: WordNet) -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted, threshold, flagged)`` for every row of ``docs(doc_id, text, lang)``.

    The score comes from the whole text alone; ``predicted`` compares it with 0.5 and ``flagged`` with the language's
    threshold. A text without words has the network's answer to nothing. A row without a key is not held out, a null or new
    language has threshold 0.5, repeated rows keep their rows, other columns are not read.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("score", score_column(docs, net))
    return rows.select(
        "doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        threshold_column(net).alias("threshold"), (F.col("score") >= threshold_column(net)).alias("flagged"),
    )
