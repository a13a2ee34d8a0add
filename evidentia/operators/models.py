"""Predictive models from ``pyspark.ml`` as they enter the causal and quality reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.sampling import hash_split
from evidentia.session import cut_lineage

ROWS_HELD = 4_000_000  # beyond which a forest counts its rows by bins instead of keeping every one with its draws
BINS = 32  # of a feature, as in pyspark.ml
BROADCAST_CELLS = 1_000_000
FITS_AT_ONCE = 4
DRAW_GROUPS = 256


def forest(features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 42, rows_held: int = ROWS_HELD) -> Forest:
    """Random forest on numeric features with an indexed label."""
    return Forest(features, label, trees, depth, seed, rows_held)


class Forest(Estimator):
    """``RandomForestClassifier`` behind an indexed label, for tables of any length.

    It keeps every row with its draw for every tree through all passes, so beyond ``rows_held`` rows the table is first
    counted by (bins of the features, label). The draws of n equal rows add up to a Poisson number of mean n, so every tree gets a
    bootstrap sample of all rows as before, in the form of weights, and trees with the same settings grow on at most as many cells as there are rows.
    """

    def __init__(self, features: Sequence[str], label: str, trees: int, depth: int, seed: int, rows_held: int):
        super().__init__()
        self.features, self.label, self.trees, self.depth, self.seed, self.rows_held = list(features), label, trees, depth, seed, rows_held

    def _fit(self, df: DataFrame) -> PipelineModel:
        index = StringIndexer(inputCol=self.label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep")
        if df.count() > self.rows_held:
            return self._fit_counts(df, index)
        return Pipeline(stages=[
            index,
            VectorAssembler(inputCols=self.features, outputCol="__features"),
            RandomForestClassifier(
                labelCol="__label", featuresCol="__features", numTrees=self.trees, maxDepth=self.depth, seed=self.seed,
            ),
        ]).fit(df)

    def _fit_counts(self, df: DataFrame, index: StringIndexer) -> PipelineModel:
        indexed = index.fit(df)
        codes = [f"__code{i}" for i in range(len(self.features))]
        binned = Bucketizer(splitsArray=_splits(df, self.features), inputCols=self.features, outputCols=codes)
        rows = binned.transform(indexed.transform(df))
        known = [F.coalesce(F.col(k), F.raise_error(F.lit(f"{c} is null"))).alias(k) for c, k in zip(self.features, codes)]
        trees, seed = self.trees, self.seed
        cells = cut_lineage(bootstrap_cells(rows.select(*codes, "__label"), trees, seed)).select(*known, "__label", "draws")
        label = F.col("__label").alias("__label", metadata=rows.schema["__label"].metadata)  # names the classes
        whole = VectorAssembler(inputCols=codes, outputCol="__codes").transform(cells).select("__codes", label, "draws").persist()

        def grown(tree: int) -> Model:
            one = RandomForestClassifier(
                labelCol="__label", featuresCol="__codes", weightCol="__weight", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt",
                maxDepth=self.depth, seed=seed + tree, probabilityCol=f"__tree{tree}", rawPredictionCol="", predictionCol="",
            )
            return one.fit(whole.withColumn("__weight", F.col("draws")[tree].cast("double")).where("__weight > 0"))

        try:
            with ThreadPool(FITS_AT_ONCE) as pool:
                grown_trees = pool.map(inheritable_thread_target(df.sparkSession)(grown), range(trees))
        finally:
            whole.unpersist()
        return PipelineModel([indexed, binned, CountedForestModel(grown_trees, codes)])


class CountedForestModel(Model, MLWritable, MLReadable):
    """Adds ``probability``, the mean of the trees', and ``prediction``. Rows with the same codes are scored once."""

    def __init__(self, trees: Sequence[Model], codes: Sequence[str]):
        super().__init__()
        self.trees, self.codes = list(trees), list(codes)

    def _transform(self, df: DataFrame) -> DataFrame:
        cells = VectorAssembler(inputCols=self.codes, outputCol="__codes").transform(df.select(*self.codes).distinct())
        for tree in self.trees:
            cells = tree.transform(cells)
        votes = F.array(*[vector_to_array(t.getProbabilityCol()) for t in self.trees])
        none = F.array(*[F.lit(0.0)] * self.trees[0].numClasses)
        total = F.aggregate(votes, none, lambda a, v: F.zip_with(a, v, lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / len(self.trees)))
        scored = cut_lineage(cells.select(*self.codes, total.alias("__share")))
        share = F.col("__share")
        ready = scored.select(
            *self.codes, array_to_vector(share).alias("probability"), (F.array_position(share, F.array_max(share)) - 1).cast("double").alias("prediction"),
        )
        return df.join(F.broadcast(ready) if scored.count() <= BROADCAST_CELLS else ready, self.codes)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: CountedForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        extra = {"codes": self.model.codes, "trees": len(self.model.trees)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        for i, tree in enumerate(self.model.trees):
            tree.save(f"{path}/tree-{i}")


class _ForestReader(MLReader):
    def load(self, path: str) -> CountedForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = CountedForestModel([RandomForestClassificationModel.load(f"{path}/tree-{i}") for i in range(metadata["trees"])], metadata["codes"])
        model._resetUid(metadata["uid"])
        return model


def bootstrap_cells(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """The distinct rows with ``draws``: how often each tree's bootstrap sample holds a row like it, whatever the partitions are."""
    keys, kinds = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def drawn(group: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(keys)
        draws = np.random.default_rng([seed, int(group[0])]).poisson(cells["n"].to_numpy()[:, None], (len(cells), trees))
        return cells[keys].assign(draws=list(draws))

    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    group = F.pmod(F.xxhash64(*keys), F.lit(DRAW_GROUPS)).alias("__group")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.withColumn("__group", group).repartition(parts, "__group").groupBy("__group").applyInPandas(drawn, f"{kinds}, draws array<bigint>")


def _splits(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Borders of at most ``BINS`` bins a feature: between any two values where there are as few, else at quantiles of all rows."""
    value = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in features]
    seen = df.agg(*[F.min(v).alias(f"lo{i}") for i, v in enumerate(value)], *[F.approx_count_distinct(v).alias(f"d{i}") for i, v in enumerate(value)]).first()
    borders: dict[int, list[float]] = {}
    for i, v in enumerate(value):
        if seen[f"d{i}"] <= 2 * BINS:
            values = sorted(r[0] for r in df.select(v.alias("v")).distinct().dropna().collect())
            if len(values) <= BINS:
                borders[i] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    wide = [i for i in range(len(value)) if i not in borders]
    if wide:
        probs = [i / BINS for i in range(1, BINS)]
        found = df.agg(*[F.percentile_approx(value[i], probs).alias(f"q{i}") for i in wide]).first()
        borders |= {i: sorted({q for q in found[f"q{i}"] if q > seen[f"lo{i}"]}) for i in wide}
    finite = [[b for b in borders[i] if np.isfinite(b)] for i in range(len(value))]
    return [[-np.inf, *(b or [0.0]), np.inf] for b in finite]


def with_confidence(model: PipelineModel, df: DataFrame, out: str = "confidence") -> DataFrame:
    """Add the predicted class index and the model's confidence in it."""
    scored = model.transform(df).withColumn(out, F.array_max(vector_to_array("probability")))
    return scored.select(*df.columns, "prediction", *(["__label"] if "__label" in scored.columns else []), out)


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("prediction") == F.col("__label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def rank_consistency(
    real: DataFrame, made: DataFrame, categories: Sequence[str], numbers: Sequence[str], label: str, key: Sequence[str], seed: int = 0
) -> DataFrame:
    """Errors of several models on real and synthetic test rows with their ranks and the rank
    correlation, null where all models rank alike: ``(model, error_real, error_synthetic, rank_real, rank_synthetic, spearman)``.

    Every row counts in every error: a missing number is 0 with a flag of its own. Numbers are floored at zero for the
    model of counts alone."""
    train, test = hash_split(real, key, 0.7, seed)
    vectors = [f"{c}__v" for c in categories]
    prepare = [
        *[StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories],
        OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=vectors, handleInvalid="keep"),
        VectorAssembler(inputCols=[*vectors, *numbers, *[f"{c}__none" for c in numbers]], outputCol="features"),
        VectorAssembler(inputCols=[*vectors, *[f"{c}__floor" for c in numbers], *[f"{c}__none" for c in numbers]], outputCol="counts"),
    ]

    def shaped(df: DataFrame) -> DataFrame:
        made = []
        for c in numbers:
            x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
            filled = F.coalesce(x, F.lit(0.0))
            made += [filled.alias(c), F.greatest(filled, F.lit(0.0)).alias(f"{c}__floor"), x.isNull().cast("double").alias(f"{c}__none")]
        return df.select(*categories, *made, F.col(label).cast("double").alias("label"))

    prep = Pipeline(stages=prepare).fit(shaped(real))
    fit_rows = prep.transform(shaped(train)).select("features", "counts", "label").persist()
    candidates = {
        "stump": DecisionTreeClassifier(maxDepth=1, seed=seed),
        "tree": DecisionTreeClassifier(maxDepth=6, seed=seed),
        "forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed),
        "logistic": LogisticRegression(maxIter=20),
        "bayes": NaiveBayes(featuresCol="counts"),
    }
    try:
        fitted = {name: estimator.fit(fit_rows) for name, estimator in candidates.items()}
    finally:
        fit_rows.unpersist()
    errors = None
    for kind, rows in (("real", test), ("synthetic", made)):
        # one pass: the predictions of all models stand on the row
        scored = prep.transform(shaped(rows)).select("features", "counts", "label")
        for name, model in fitted.items():
            renamed = model.copy().setPredictionCol(f"{name}__p").setProbabilityCol(f"{name}__q").setRawPredictionCol(f"{name}__r")
            scored = renamed.transform(scored)
        wrong = [F.avg((F.col(f"{name}__p") != F.col("label")).cast("double")).alias(name) for name in fitted]
        one = scored.agg(*wrong).select(F.explode(F.create_map(*[x for name in fitted for x in (F.lit(name), F.col(name))])).alias("model", "error"), F.lit(kind).alias("kind"))
        errors = one if errors is None else errors.unionByName(one)
    wide = errors.groupBy("model").pivot("kind", ["real", "synthetic"]).agg(F.first("error"))
    everything = W.partitionBy()  # a row per model
    ranked = wide.select(
        "model", F.col("real").alias("error_real"), F.col("synthetic").alias("error_synthetic"),
        F.rank().over(everything.orderBy("real")).alias("rank_real"),
        F.rank().over(everything.orderBy("synthetic")).alias("rank_synthetic"),
    )
    # models that all err alike have one rank and no correlation
    varied = [F.min(c).over(everything) < F.max(c).over(everything) for c in ("rank_real", "rank_synthetic")]
    marked = ranked.withColumn("varied", varied[0] & varied[1])
    return marked.withColumn("spearman", F.corr(F.when(F.col("varied"), F.col("rank_real")), "rank_synthetic").over(everything)).drop("varied")
