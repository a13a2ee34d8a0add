"""Feature selection by causal effect: a greedy walk over one contingency table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from evidentia.functions.binning import fit_left_closed, left_codes
from evidentia.operators.counts import contingency
from evidentia.operators.entropy import causal_effects
from evidentia.operators.selection import FeatureParams, SelectorModel

STEPS_PER_JOB = 8


@dataclass
class Effect:
    feature: str
    position: int
    effect: float
    selected: bool


def binned_cells(df: DataFrame, features: Sequence[str], target: str, n_bins: int | str = "auto") -> DataFrame:
    """Bin once, count once: the rows are read for the bin parameters and for this table only."""
    specs = fit_left_closed(df, [*features, target], n_bins)
    codes = df.select(*[code.alias(c) for c, code in left_codes(specs).items()])
    return contingency(codes, [*features, target])


def greedy_effects(cells: DataFrame, features: Sequence[str], target: str, min_effect: float = 0.0) -> list[Effect]:
    """Walk the features in order; keep one if its effect given those kept so far is above zero.

    A job evaluates several steps ahead as if every one were kept. Only a rejected feature
    makes the steps after it wrong, and these are asked again.
    """
    kept: list[str] = []
    walked: list[Effect] = []
    while len(walked) < len(features):
        at = len(walked)
        ahead = list(features[at : at + STEPS_PER_JOB])
        steps = [(c, [*kept, *ahead[:i]]) for i, c in enumerate(ahead)]
        rows = {r["step"]: r for r in causal_effects(cells, target, steps).collect()}
        for i, c in enumerate(ahead):
            on = rows[i]["dependent"] and (min_effect <= 0 or rows[i]["effect"] > min_effect)
            walked.append(Effect(c, at + i, rows[i]["effect"], bool(on)))
            if not on:
                break
            kept.append(c)
    return walked


class CausalFeatureSelector(Estimator, FeatureParams, DefaultParamsWritable, DefaultParamsReadable):
    """Keeps a feature if, given the features kept before it, it still changes the entropy of the
    label. Numeric columns only, binned into ``nBins`` equal-width bins or by the inter-quartile rule.

    Plug-in conditional mutual information is never negative, so any chance dependence selects a
    feature; ``minEffect`` asks for more than that.
    """

    nBins = Param(Params._dummy(), "nBins", "bin count, or 'auto'")
    minEffect = Param(Params._dummy(), "minEffect", "least effect in bits", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, keepCols=None, nBins="auto", minEffect=0.0):
        super().__init__()
        self._setDefault(nBins="auto", minEffect=0.0)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> SelectorModel:
        features, label = self.features(df), self.label(df)
        cells = binned_cells(df, features, label, self.getOrDefault("nBins")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            walked = greedy_effects(cells, features, label, self.getOrDefault("minEffect"))
        finally:
            cells.unpersist()
        return SelectorModel.of(self, df, features, [e.feature for e in walked if e.selected], {e.feature: e.effect for e in walked})
