"""Language of a text by a small convolutional network over its bytes.

A text is cut into windows of fixed length that cover all of it. Filters of several widths run over the
bytes' embeddings, each keeps its largest answer in the window, and a softmax layer weighs them. The
windows' log-probabilities are averaged over the text. Everything is trained here, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fold, prepare, text_or_empty

WINDOW = 256
WIDTHS = (2, 4, 6)
CHUNK = 512  # windows that go through the network at once
UNKNOWN = "und"


def cut_windows(raw: bytes) -> np.ndarray:
    """Windows of 256 bytes that cover a text; the last ends where the text does, a short text is filled with zeros."""
    if len(raw) <= WINDOW:
        return np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8).reshape(1, WINDOW)
    whole = len(raw) // WINDOW
    out = np.frombuffer(raw, np.uint8, whole * WINDOW).reshape(whole, WINDOW)
    return out if len(raw) == whole * WINDOW else np.vstack([out, np.frombuffer(raw[-WINDOW:], np.uint8)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class ByteNet:
    """``languages`` with embeddings (256 x d), filters (width x d x f), their biases and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    intercepts: np.ndarray

    @classmethod
    def start(cls, languages: list[str], d: int = 8, f: int = 8, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(np.prod(shape[:-1])), shape).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        embedding = rng.normal(0, 0.5, (256, d)).astype(np.float32)
        embedding[0] = 0
        return cls(languages, embedding, [draw(w, d, f) for w in WIDTHS], [zeros(f) for _ in WIDTHS],
                   draw(f * len(WIDTHS), len(languages)), zeros(len(languages)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.weights, self.intercepts]

    def gradients(self, batch: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Mean gradient of the cross-entropy over windows (n x 256) with numbers of languages."""
        n, x = len(batch), self.embedding[batch]
        rows = np.arange(n)[:, None]
        pooled, places = [], []
        for k, b in zip(self.filters, self.biases):
            w, d, f = k.shape
            spans = np.lib.stride_tricks.sliding_window_view(x, w, 1)  # n, positions, d, w
            answers = spans.transpose(0, 1, 3, 2).reshape(n, -1, w * d) @ k.reshape(w * d, f) + b
            at = answers.argmax(1)
            places.append(at)
            pooled.append(answers[rows, at, np.arange(f)])
        raw = np.hstack(pooled)
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.weights + self.intercepts
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), target] -= 1
        p /= n
        back = (p @ self.weights.T) * (raw > 0)
        g_embedding, g_filters, g_biases = np.zeros_like(self.embedding), [], []
        for i, (k, at) in enumerate(zip(self.filters, places)):
            w, d, f = k.shape
            g = back[:, i * f : (i + 1) * f]
            g_filter = np.empty_like(k)
            for j in range(w):
                codes = batch[rows, at + j]  # n, f
                g_filter[j] = np.einsum("nfd,nf->df", self.embedding[codes], g)
                np.add.at(g_embedding, codes, g[:, :, None] * k[j].T[None])
            g_filters.append(g_filter)
            g_biases.append(g.sum(0))
        g_embedding[0] = 0
        return [g_embedding, *g_filters, *g_biases, hidden.T @ p, p.sum(0)]

    def tables(self) -> list[list[np.ndarray]]:
        """For every width, the answers of each pair of filter rows to all 65,536 pairs of bytes."""
        out = []
        for k in self.filters:
            single = np.einsum("bd,wdf->wbf", self.embedding, k)
            out.append([(single[j][:, None] + single[j + 1][None]).reshape(65536, -1) for j in range(0, len(k), 2)])
        return out

    def log_probabilities(self, batch: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log-probability of every language for windows (n x 256)."""
        pairs = batch[:, :-1].astype(np.uint16) * 256 + batch[:, 1:]
        pooled = []
        for parts, b in zip(tables, self.biases):
            last = pairs.shape[1] - 2 * (len(parts) - 1)
            answers = parts[0].take(pairs[:, :last], 0)
            for j, part in enumerate(parts[1:], 1):
                answers += part.take(pairs[:, 2 * j : 2 * j + last], 0)
            pooled.append(answers.max(1) + b)
        logits = np.maximum(np.hstack(pooled), 0) @ self.weights + self.intercepts
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def adam(parameters: list[np.ndarray], rate: float):
    """A step function that moves the parameters along gradients, with moments kept between calls."""
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    count = 0

    def step(gradients: list[np.ndarray]) -> None:
        nonlocal count
        count += 1
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)

    return step


def train(languages: list[str], windows: np.ndarray, target: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 3) -> ByteNet:
    """Fit on windows with numbers of languages; languages count alike however many windows they have."""
    net = ByteNet.start(languages)
    step = adam(net.parameters(), 0.005)
    rng = np.random.default_rng(seed)
    share = np.bincount(target, minlength=len(languages)).astype(float)
    odds = 1 / share[target]
    for _ in range(epochs * max(1, len(target) // batch)):
        chosen = rng.choice(len(target), min(batch, len(target)), p=odds / odds.sum())
        step(net.gradients(windows[chosen], target[chosen]))
    return net


def training_windows(docs: DataFrame, rows: int, windows: int) -> DataFrame:
    """About ``rows`` documents shared evenly over the languages, as ``(lang, windows)`` of up to ``windows`` spread windows.

    A hash of the key draws them, and of a key's rows one stays.
    """
    keyed = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("doc_id", 4) != 2).select("doc_id", "lang")
    counts = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, windows binary")
    part = rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, part / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                cuts = cut_windows(text.encode("utf-8", "replace"))
                at = np.unique(np.linspace(0, len(cuts) - 1, windows).astype(int))
                out.append(cuts[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.binary())], ["doc_id", "lang", "windows"])

    chosen = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold("doc_id", 4) != 2).where(draw < share[F.col("lang")])
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = chosen.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(pick, f"doc_id {kind}, lang string, windows binary")
    return picked.dropDuplicates(["doc_id"]).select("lang", "windows")


def fit(docs: DataFrame, rows: int = 3000, windows: int = 4) -> ByteNet | None:
    """A network from a bounded sample of ``docs(doc_id, text, lang)``, or None where nothing is labelled.

    ``rows`` documents with ``windows`` windows each are what the driver gets. Documents of fold 2 of 4 are never
    learned from.
    """
    prepare(docs.sparkSession)
    sample = sorted((r.lang, bytes(r.windows)) for r in training_windows(docs, rows, windows).collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    cuts = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in sample]
    target = np.repeat([languages.index(lang) for lang, _ in sample], [len(c) for c in cuts])
    return train(languages, np.vstack(cuts), target)


def predict(net: ByteNet | None, texts: list[str], tables: list[list[np.ndarray]]) -> list[tuple[str, float]]:
    """Language and its probability for every text; texts without a letter are ``und`` with score 0."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    cuts = [(i, cut_windows(t.encode("utf-8", "replace"))) for i, t in enumerate(texts) if net and has_letter(t)]
    if not cuts:
        return out
    lengths = [len(c) for _, c in cuts]
    stack = np.vstack([c for _, c in cuts])
    scores = np.vstack([net.log_probabilities(stack[a : a + CHUNK], tables) for a in range(0, len(stack), CHUNK)])
    starts = np.cumsum([0, *lengths[:-1]])
    means = np.add.reduceat(scores, starts, 0) / np.array(lengths)[:, None]
    shares = np.exp(means - means.max(1, keepdims=True))
    shares /= shares.sum(1, keepdims=True)
    for (i, _), s in zip(cuts, shares):
        out[i] = net.languages[s.argmax()], float(s.max())
    return out


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    The whole text counts. ``lang_pred`` is ``und`` with score 0 for a null text, a text without a letter, and where
    nothing was learned. A row without a key is not held out; repeated rows keep their rows; ties go to the
    language that comes first by name. Other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model else []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for a in range(0, len(texts), 64) for x in predict(model, texts[a : a + 64], tables)]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
