"""Fitted models are saved with their tables, alone and in a pipeline, and score alike afterwards."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from evidentia import NetworkFeatureGenerator, SequenceOutlierDetector, SyntheticGenerator, TabularOutlierDetector, UnitImportance
from evidentia.functions.quantiles import weighted_quantile
from evidentia.operators.layers import UnitImportanceModel
from evidentia.operators.outliers import TabularOutlierModel
from evidentia.operators.selection import FirstKSelector
from evidentia.operators.sequences import SequenceOutlierModel, previous_values, slice_edges
from evidentia.operators.synth import SyntheticModel


def rows(spark, n=240):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.9, a, (a + 1) % 3)
    x, y = rng.normal(a, 0.3), rng.normal(0, 1, n)
    listed = [(i, int(p), int(q), float(u), float(v), i % 2) for i, (p, q, u, v) in enumerate(zip(a, b, x, y))]
    return spark.createDataFrame(listed, "id bigint, a int, b int, x double, y double, spare int")


def same(one, other, key):
    first, second = (df.orderBy(*key).collect() for df in (one, other))
    assert len(first) == len(second)
    for r, s in zip(first, second):
        assert r.asDict() == pytest.approx(s.asDict())


def test_pipeline_of_selector_network_and_detector(spark, tmp_path):
    df = rows(spark)
    stages = [
        FirstKSelector(featureCols=["a", "b", "x", "y", "spare"], keepCols=["id"], k=4),
        NetworkFeatureGenerator(featureCols=["a", "b"], knownStructure=[("a", "b")]),
        TabularOutlierDetector(keyCols=["id"], numericCols=["x", "y"], categoryCols=["a", "b"], knownStructure=[("a", "b")], numericParents={"x": ["a"]}, bags=[["x", "y"], ["x"]]),
    ]
    model = Pipeline(stages=stages).fit(df)
    path = str(tmp_path / "pipeline")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages] and [s.uid for s in again.stages] == [s.uid for s in model.stages]
    fresh = df.withColumn("x", F.col("x") + F.when(F.col("id") % 3 == 0, 0.01).otherwise(0.0))
    same(model.transform(fresh), again.transform(fresh), ["id"])
    features = model.stages[1].transform(model.stages[0].transform(df))
    same(model.stages[2].predict(features), again.stages[2].predict(features), ["id"])


def test_models_are_saved_in_place_of_what_is_there(spark, tmp_path):
    df = rows(spark)
    path = str(tmp_path / "model")
    for categories in (["a", "b"], []):
        made = TabularOutlierDetector(keyCols=["id"], numericCols=["y"], categoryCols=categories, knownStructure=[], bags=[["y"]], nodes=categories).fit(df)
        made.save(path)
        same(made.transform(df), TabularOutlierModel.load(path).transform(df), ["id"])
    generator = SyntheticGenerator(featureCols=["a", "b"], knownStructure=[("a", "b")], numericParents={"x": ["a"], "y": []}).fit(df)
    generator.save(path)
    same(generator.sample(100, 3), SyntheticModel.load(path).sample(100, 3), ["id"])
    with pytest.raises(Exception):
        generator.write().save(path)


def test_unit_importance(spark, tmp_path):
    rng = np.random.default_rng(1)
    acts = spark.createDataFrame([(s, layer, u, rng.normal(0, 1, 3).tolist()) for s in range(30) for layer, k in (("one", 3), ("two", 2)) for u in range(k)], "sample_id int, layer string, unit int, response array<double>")
    model = UnitImportance(layers=["one", "two"]).fit(acts)
    model.save(str(tmp_path / "units"))
    same(model.importance(acts), UnitImportanceModel.load(str(tmp_path / "units")).importance(acts), ["layer", "unit"])


def walk(spark, n=1500):
    """Two states of some entities: ``b`` follows the ``a`` before, ``a`` follows itself, ``c`` nothing."""
    rng = np.random.default_rng(8)
    listed = []
    for e in range(5):
        a = 0
        for t in range(n // 5):
            b = a if rng.random() < 0.95 else int(rng.integers(0, 3))
            a = a if rng.random() < 0.8 else int(rng.integers(0, 3))
            listed.append((e, t, a, b, int(rng.integers(0, 2))))
    return spark.createDataFrame(listed, "e int, t int, a int, b int, c int")


def test_edges_between_slices_are_found(spark, tmp_path):
    df = walk(spark)
    model = SequenceOutlierDetector(entityCol="e", orderCols=["t"], stateCols=["a", "b", "c"], contamination=0.02).fit(df)
    assert set(model.edges) == {("previous_a", "a"), ("previous_a", "b")}
    assert all(p.startswith("previous_") and not c.startswith("previous_") for p, c in model.edges)
    scored = model.transform(df)
    assert scored.where("score IS NULL").count() == 5  # the first of every entity
    odd = scored.where("prediction = -1")
    assert 0 < odd.count() <= 0.025 * df.count() and odd.where("b <> previous_a OR a <> previous_a").count() == odd.count()
    model.save(str(tmp_path / "seq"))
    same(scored, SequenceOutlierModel.load(str(tmp_path / "seq")).transform(df), ["e", "t"])


def test_scores_of_several_states_are_sums(spark):
    df = walk(spark, 400)
    model = SequenceOutlierDetector(entityCol="e", orderCols=["t"], stateCols=["a", "b"], sliceEdges=[("a", "a"), ("a", "b")]).fit(df)
    pairs = [r for r in previous_values(df, "e", ["t"], {"a": "pa", "b": "pb"}, "met").where("met").collect()]
    n, table = {}, {}
    for r in pairs:
        for child in ("a", "b"):
            table[child, r.pa, r[child]] = table.get((child, r.pa, r[child]), 0) + 1
            n[child, r.pa] = n.get((child, r.pa), 0) + 1
    prob = lambda child, p, v: (table.get((child, p, v), 0) + 5 / 9) / (n[child, p] + 5 / 3)
    for r in model.transform(df).where("score IS NOT NULL").collect():
        assert r.score == pytest.approx(-math.log(prob("a", r.previous_a, r.a)) - math.log(prob("b", r.previous_a, r.b)))
    one = df.limit(1)
    empty = slice_edges(previous_values(one, "e", ["t"], {"a": "pa", "b": "pb"}, "met").where("met").groupBy("pa", "pb", "a", "b").agg(F.count("*").alias("n")), {"a": "pa", "b": "pb"})
    assert empty == []


def test_weighted_quantile(spark):
    rng = np.random.default_rng(3)
    cells = [(float(v), int(w)) for v, w in zip(np.round(rng.normal(0, 1, 300), 1), rng.integers(0, 9, 300))]
    df = spark.createDataFrame([*cells, (None, 5), (float("nan"), 2)], "v double, w int")
    flat = np.repeat([v for v, _ in cells], [w for _, w in cells])
    for p in (0.0, 0.25, 0.5, 0.95, 0.999, 1.0):
        assert weighted_quantile(df, "v", "w", p) == pytest.approx(np.quantile(flat, p))
    assert weighted_quantile(spark.createDataFrame([(1.0, 10**12), (2.0, 3 * 10**12)], "v double, w bigint"), "v", "w", 0.5) == 2.0
    assert math.isnan(weighted_quantile(df.limit(0), "v", "w", 0.5))


def test_columns_that_a_result_adds_are_refused(spark):
    df = rows(spark)
    model = TabularOutlierDetector(keyCols=["id"], numericCols=["y"], bags=[["y"]]).fit(df)
    for name in ("score", "LOF_score", "bn_score"):
        with pytest.raises(ValueError, match="adds"):
            model.transform(df.withColumn(name, F.lit(1)))
    with pytest.raises(ValueError, match="adds"):
        model.predict(df.withColumn("prediction", F.lit(1)))
    with pytest.raises(ValueError, match="adds"):
        model.decision_function(df.withColumn("decision", F.lit(1)))
    events = walk(spark, 50)
    with pytest.raises(ValueError, match="adds"):
        SequenceOutlierDetector(entityCol="e", orderCols=["t"], stateCol="a").fit(events).transform(events.withColumn("previous", F.lit(1)))


def test_a_category_column_named_like_an_inner_one(spark):
    df = rows(spark).withColumnRenamed("a", "cdf").withColumnRenamed("b", "u")
    made = SyntheticGenerator(featureCols=["cdf", "u"], knownStructure=[("cdf", "u")]).fit(df).sample(50)
    assert made.columns == ["id", "cdf", "u"] and made.where("cdf IS NULL OR u IS NULL").count() == 0
