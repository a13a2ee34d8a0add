"""Inputs shared by the tests of this folder."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "id bigint, key string, uid bigint, text_id string, digest string, score double, kept boolean, component_id bigint, shard int, held_out boolean, n_tokens bigint"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD_ROWS = [
    (1, "", "en"), (2, None, "en"), (3, "one two three four five six", None), (None, "text without a key", "en"),
    (4, LONG, "en"), (5, "twice the same text here now", "fr"), (6, "twice the same text here now", None), (5, "twice the same text here now", "fr"),
    (7, " \n\t \x0b", "de"), (8, "12345 --- 67 !!", "en"), (None, None, None), (9, "Ünïcode ça été \U0001f600 ﬃ", "de"),
]


def docs_table(spark, rows):
    """Documents of ``(doc_id, text, lang)`` with the other columns, null at times."""
    return spark.createDataFrame([(i, t, lang, None if n % 3 else "src", None if t is None else len(t)) for n, (i, t, lang) in enumerate(rows)], DOCS)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    docs = docs_table(spark, ODD_ROWS)
    return docs.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")])


def no_docs(spark):
    return docs_table(spark, []).limit(0)


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def random_texts(n: int, seed: int = 0) -> list[str]:
    """Strings that are hard on tokenizers: white space of all kinds, marks, contractions, special strings, other scripts."""
    rng = random.Random(seed)
    parts = [
        " ", "  ", "\n", " \n", "\t", "\r\n", " ", " ", "\u0085", "\x1c", "\x0b", "the", " the", "Word", "IT'S", "don't", "'ll", "x's.", "end.", "end,.,", ",", ".",
        "...", "12", " 345", "½", "é", "é", "Å", "İ", "ΑΣ", "ß", "日本語", "한국", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|", "##", "a_b", "ﬁ", "Ͱx.", "ᲊ.", "\x00",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
