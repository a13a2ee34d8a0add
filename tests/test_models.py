"""Forests that count equal rows, against those that keep every row."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from evidentia.operators.models import accuracy, bootstrap_cells, forest, with_confidence

COUNTED = 0  # rows that are kept one by one


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows of 40 x 5 values: the label follows the first two columns but for every 20th row and is missing in every 50th."""
    df = spark.range(2000).select("id", (F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 7 % 5).cast("int").alias("z"), F.lit(3.5).alias("same"))
    flag = F.when(F.col("id") % 50 == 0, None).when((F.col("x") > 20) != (F.col("id") % 20 == 3), "up").when(F.col("z") > 2, "mid").otherwise("low")
    return df.withColumn("flag", flag)


def test_draws_are_those_of_single_rows(spark):
    """A cell of n rows is drawn Poisson(n) times by every tree."""
    sizes = {1: 1, 2: 30, 3: 900}
    df = spark.createDataFrame([(float(k),) for k, n in sizes.items() for _ in range(n)], "k double")
    found = {int(r["k"]): r["draws"] for r in bootstrap_cells(df, 2000, 5).collect()}
    assert found.keys() == sizes.keys()
    for k, n in sizes.items():
        mean = sum(found[k]) / 2000
        assert abs(mean - n) < 5 * (n / 2000) ** 0.5
        assert abs(sum((d - mean) ** 2 for d in found[k]) / 2000 / n - 1) < 0.2


def test_draws_do_not_depend_on_partitions(rows):
    found = [{(r["x"], r["z"]): r["draws"] for r in bootstrap_cells(rows.repartition(n).select("x", "z"), 3, 1).collect()} for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == rows.select("x", "z").distinct().count()


def test_counted_forest_is_as_good_as_one_of_rows(rows):
    features, scores = ["x", "z", "same"], {}
    for held in (COUNTED, rows.count()):
        scored = with_confidence(forest(features, "flag", rows_held=held).fit(rows), rows)
        assert scored.columns == [*rows.columns, "prediction", "__label", "confidence"]
        found = accuracy(scored).first()
        assert found["n"] == 2000
        low, high = scored.agg(F.min("confidence"), F.max("confidence")).first()
        assert 0.25 <= low <= high <= 1 + 1e-9
        scores[held] = found["accuracy"], scored.agg(F.avg("confidence")).first()[0]
    assert scores[COUNTED][0] == pytest.approx(scores[2000][0], abs=0.03)
    assert scores[COUNTED][1] == pytest.approx(scores[2000][1], abs=0.05)


def test_missing_number_is_refused_either_way(rows):
    holed = rows.withColumn("x", F.when(F.col("id") != 77, F.col("x")))
    for held in (COUNTED, 2000):
        with pytest.raises((PySparkException, Py4JJavaError), match="(?i)null"):
            forest(["x", "z"], "flag", trees=2, rows_held=held).fit(holed)


def test_counted_forest_is_saved(rows, tmp_path):
    model = forest(["x", "z"], "flag", trees=2, rows_held=COUNTED).fit(rows)
    model.save(str(tmp_path / "forest"))
    again = PipelineModel.load(str(tmp_path / "forest"))
    found = [sorted(with_confidence(m, rows).select("id", "prediction", "confidence").collect()) for m in (model, again)]
    assert found[0] == found[1] and len(found[0]) == 2000
