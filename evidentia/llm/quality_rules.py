"""Quality rules: base counts of a text, and how far its histograms lie from its language's reference.

Two histograms of a document are compared with the mean of its language by Jensen-Shannon distance:
classes of characters, and common words with all others as one class. Texts too short for a
histogram to mean anything are not judged by it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.common import WORD_HASHES, repeated_words, prepare, text_or_empty
from evidentia.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "letter", "digit", "space", "point", "symbol", "other"]
SCALE = 1_000_000  # shares are summed as whole millionths, so that no order of rows changes a reference
LONG, WIDE = 200_000, 1 << 26  # words and bytes of words in a task's table, above which it is passed on and begun anew


@lru_cache(1)
def class_table() -> np.ndarray:
    """Number of the class of every code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    by = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "L": "letter", "N": "digit", "Z": "space", "P": "point", "S": "symbol"}
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        name = by.get(kind) or by.get(kind[0])
        if name:
            table[code] = CLASSES.index(name)
    table[[ord(c) for c in SPACES]] = CLASSES.index("space")
    table[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
    return table


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text whose words are given."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(WORD_HASHES.of(words)),
    )


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[codes], minlength=len(CLASSES))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts ``(lang, word, n)`` of a task's words; a word comes again whenever the table became long in between."""
    counts: dict[str | None, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(text.encode("utf-8", "replace").split())
            if sum(map(len, counts.values())) > LONG:
                yield _rows_of(counts)
                counts = {}
        if sum(len(w) for c in counts.values() for w in c) > WIDE:
            yield _rows_of(counts)
            counts = {}
    yield _rows_of(counts)


def _rows_of(counts: dict[str | None, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in range(len(c))]
    words = [w.decode("utf-8", "replace") for c in counts.values() for w in c]
    ns = [n for c in counts.values() for n in c.values()]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "n"])


def common_words(docs: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent words of every language as ``(lang, words)``, most frequent first.

    Counts are exact: every task passes on all its words with their counts. Every part of the sums keeps its own
    ``top`` words of a language before those are gathered.
    """
    texts = docs.select("lang", text_or_empty().alias("text"))
    counts = texts.mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return (
        counts.withColumn("place", place).where(F.col("place") <= top)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
        .select("lang", F.col("w.word").alias("words"))
    )


def _measure(lists: dict[str | None, list[str]], top: int):
    """Base counts and both histograms, as whole millionths, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in lists.items()}
        for batch in batches:
            base, classes, commons = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = text.encode("utf-8", "replace").split()
                base.append(base_counts(text, words))
                seen = class_counts(text)
                classes.append((seen * SCALE // max(1, seen.sum())).tolist())
                place = index.get(lang, {})
                found = [i for w in words if (i := place.get(w)) is not None]
                hist = np.bincount(np.array(found, np.int64), minlength=top + 1)
                hist[top] = len(words) - len(found)
                commons.append((hist * SCALE // max(1, len(words))).tolist())
            columns = [pa.array(x, pa.int64()) for x in (zip(*base) if base else [()] * 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), *columns, pa.array(classes, pa.list_(pa.int64())), pa.array(commons, pa.list_(pa.int64()))],
                ["doc_id", "lang", *BASE, "classes", "commons"],
            )

    return run


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two columns of shares in millionths."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def both(x: Column, y: Column) -> Column:
        x, y = x / F.lit(float(SCALE)), y / F.lit(float(SCALE))
        return (part(x, y) + part(y, x)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda a, x: a + x)))


def judge(
    docs: DataFrame, top: int = 50, class_limit: float = 0.28, word_limit: float = 0.42, class_words: int = 50, word_words: int = 100
) -> DataFrame:
    """Base counts, both distances and the verdict for every row of ``docs(doc_id, text, lang)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed and kept. A row is kept if it passes the base (20 words, at most 30 % of
    them in repeated windows) and neither distance is above its limit; a distance is null, and no reason to
    reject, below its number of words and where the language has no reference. A null text counts as
    empty, a null language is a language of its own, null keys and repeated rows keep their rows. The
    language decides only which reference is meant; a reference is the mean over all documents of 20 words.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    lists = {r.lang: r.words for r in common_words(docs, top).collect()}  # `top` words to a language
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{c} bigint' for c in BASE)}, classes array<bigint>, commons array<bigint>"
    measured = cut_lineage(docs.select("doc_id", "lang", text_or_empty().alias("text")).mapInArrow(_measure(lists, top), schema))
    shares = lambda name, n: [F.sum(F.col(name)[i]).alias(f"{name}_{i}") for i in range(n)]
    sums = measured.where("n_words >= 20").groupBy("lang").agg(F.count("*").alias("n"), *shares("classes", len(CLASSES)), *shares("commons", top + 1))
    mean = lambda name, n: F.array(*[F.expr(f"{name}_{i} div n") for i in range(n)]).alias(f"{name}_ref")
    refs = cut_lineage(sums.select(F.col("lang").alias("ref_lang"), mean("classes", len(CLASSES)), mean("commons", top + 1)))
    rows = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    distances = {
        "class_distance": F.when(F.col("n_words") >= class_words, js_distance("classes", "classes_ref")),
        "word_distance": F.when(F.col("n_words") >= word_words, js_distance("commons", "commons_ref")),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > class_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return rows.withColumns(distances).select(
        "doc_id", *BASE, "class_distance", "word_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept")
    )
