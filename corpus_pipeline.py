"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but the last return the
columns that they got. Labels are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import quality_model, toxicity
from evidentia.llm.common import text_or_empty
from evidentia.llm.minhash import near_duplicates
from evidentia.llm.packing import pack_documents
from evidentia.plans.common import table
from evidentia.session import cut_lineage


def _filtered(docs: DataFrame, score: Column, keeps) -> DataFrame:
    """The rows whose score passes, with their columns; the score's own column has a name that no table has."""
    name = f"score-{uuid.uuid4().hex}"
    return docs.withColumn(name, score).where(keeps(F.col(f"`{name}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model expects to be of good quality: P(grade >= 1) of at least 0.5. Without labels, all."""
    model = quality_model.fit(docs, quality_model.ratings_of(table(spark, sf_dir, "labels")))
    return _filtered(docs, quality_model.score_column(docs, model), lambda s: F.coalesce(s["tail_probability"], F.lit(1.0)) >= 0.5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold of their language."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, toxicity.score_column(docs, net), lambda s: s < toxicity.threshold_column(net))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest doc_id; null comes last.

    Every row is judged by its own words, whatever its doc_id. Texts without words are copies only of equal texts of the same doc_id.
    """
    row, mark = (f"{part}-{uuid.uuid4().hex}" for part in ("row", "mark"))  # names that no table has
    columns = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.md5(text_or_empty().cast("binary"))
    rows = cut_lineage(docs.select(*columns, F.monotonically_increasing_id().alias(row), digest.alias(mark)))
    judged = near_duplicates(rows.select(F.col(f"`{row}`").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    marks = rows.select(F.col(f"`{row}`").alias("row"), F.col(f"`{mark}`").alias("mark"), "doc_id")
    repeated = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~repeated, F.col("component_id")), F.when(repeated, F.col("doc_id")), F.when(repeated, F.col("mark"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row"))
    firsts = judged.join(marks, "row").groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(first.alias("first"))
    kept = cut_lineage(firsts.select(F.col("first.row").alias(row)))
    return rows.join(kept.hint("merge"), row, "left_semi").select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_good), ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
