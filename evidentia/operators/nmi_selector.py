"""Feature selection by normalised mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binning import DEFAULT_BINS
from evidentia.operators.entropy import CodedTable, nmi
from evidentia.operators.selection import FeatureParams, SelectorModel

DEFAULT_THRESHOLD = 0.5
PAIRS_PER_JOB = 200
TIE = 1e-12  # sums of doubles have no fixed order: values closer than this count as equal


def relevance(df: DataFrame | CodedTable, features: Sequence[str], target: str, mode: str = "standard", bin_count: int = DEFAULT_BINS) -> DataFrame:
    """NMI of every feature with the target: ``(feature, nmi)``."""
    scores = nmi(df, [(c, target) for c in features], mode, bin_count)
    return scores.select(F.col("col_a").alias("feature"), "nmi")


def dominance(scores: DataFrame, pair_scores: DataFrame, threshold: float) -> DataFrame:
    """Relevant features that make some other one redundant: nmi(a, t) > nmi(b, t) and
    nmi(a, b) > nmi(b, t). ``scores`` is ``(feature, nmi)``, ``pair_scores`` ``(col_a, col_b, nmi)``."""
    a = scores.select(F.col("feature").alias("col_a"), F.col("nmi").alias("nmi_a"))
    b = scores.select(F.col("feature").alias("col_b"), F.col("nmi").alias("nmi_b"))
    shown = (
        pair_scores.select("col_a", "col_b", F.col("nmi").alias("nmi_ab"))
        .join(F.broadcast(a), "col_a")  # a row per column
        .join(F.broadcast(b), "col_b")
        .where(
            (F.col("nmi_a") > threshold + TIE)
            & (F.col("nmi_a") > F.col("nmi_b") + TIE)
            & (F.col("nmi_ab") > F.col("nmi_b") + TIE)
        )
    )
    return scores.join(shown.select(F.col("col_a").alias("feature")), "feature", "left_semi")


class NMIFeatureSelector(Estimator, FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """Two stages. Stage 1 keeps features whose NMI with the label is above ``threshold``. Unless
    exactly one is left, stage 2 keeps only those that dominate some other feature, relevant or not;
    a relevant feature that makes nothing redundant is dropped.

    With ``mode='counts'`` the threshold defaults to 0.5. In ``standard`` mode the value never
    exceeds 0.5, so the caller must name a threshold.
    """

    threshold = Param(Params._dummy(), "threshold", "least NMI with the label (exclusive)", TypeConverters.toFloat)
    binCount = Param(Params._dummy(), "binCount", "bins of a floating column", TypeConverters.toInt)
    mode = Param(Params._dummy(), "mode", "'standard' or 'counts'", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, keepCols=None, threshold=None, binCount=DEFAULT_BINS, mode="standard"):
        super().__init__()
        self._setDefault(binCount=DEFAULT_BINS, mode="standard")
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SelectorModel:
        features, label = self.features(df), self.label(df)
        mode, bins = self.getOrDefault("mode"), self.getOrDefault("binCount")
        if self.isDefined("threshold"):
            threshold = self.getOrDefault("threshold")
        elif mode == "counts":
            threshold = DEFAULT_THRESHOLD
        else:
            raise ValueError("standard mode needs a threshold")
        coded = CodedTable.of(df, [*features, label], mode, bins)  # bins are fitted once for both stages
        coded.rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            score = {r["feature"]: r["nmi"] for r in relevance(coded, features, label, mode, bins).collect()}
            relevant = [c for c in features if score[c] is not None and score[c] > threshold + TIE]
            chosen = relevant if len(relevant) == 1 else self._dominant(coded, features, relevant, score, mode, bins)
        finally:
            coded.rows.unpersist()
        return SelectorModel.of(self, df, features, chosen, score)

    def _dominant(self, df, features, relevant, score, mode, bins) -> list[str]:
        # Only pairs that pass the first condition are counted, in batches of bounded width.
        pairs = [(a, b) for a in relevant for b in features if a != b and score[b] is not None and score[a] > score[b] + TIE]
        chosen: set[str] = set()
        for start in range(0, len(pairs), PAIRS_PER_JOB):
            batch = [p for p in pairs[start : start + PAIRS_PER_JOB] if p[0] not in chosen]
            if not batch:
                continue
            for r in nmi(df, batch, mode, bins).collect():
                if r["nmi"] is not None and r["nmi"] > score[r["col_b"]] + TIE:
                    chosen.add(r["col_a"])
        return [c for c in relevant if c in chosen]
