import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions.binning import auto_bins, fit_left_closed, fit_right_closed, left_codes, right_codes
from evidentia.functions.quantiles import exact_quantiles
from evidentia.operators.counts import code_histogram, contingency_2d, enumerate_codes


def codes(df, specs, maker, col="x"):
    return [r[0] for r in df.orderBy("id").select(maker(specs)[col]).collect()]


def frame(spark, values, dtype="double"):
    return spark.createDataFrame(list(enumerate(values)), f"id bigint, x {dtype}")


def test_even_numbers_in_four_bins(spark):
    values = list(range(-8, 9, 2))  # edges at -8, -4, 0, 4 and 8; the last bin is closed
    df = frame(spark, values, "bigint")
    assert codes(df, fit_left_closed(df, ["x"], 4), left_codes) == [min((v + 8) // 4, 3) for v in values]


def test_constant_column(spark):
    df = frame(spark, [4.0] * 5)
    specs = fit_left_closed(df, ["x"])
    assert specs["x"].bins == 2
    assert codes(df, specs, left_codes) == [1] * 5
    assert codes(df, fit_right_closed(df, ["x"]), right_codes) == [49] * 5


def test_left_closed_like_edge_search(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.uniform(0, 0.1, 500), 2)
    df = frame(spark, values.tolist())
    for bins in (2, 3, 7, 10):
        edges = np.linspace(values.min(), values.max(), bins + 1)
        expected = np.clip(np.digitize(values, edges) - 1, 0, bins - 1)
        assert codes(df, fit_left_closed(df, ["x"], bins), left_codes) == expected.tolist()


def test_right_closed_like_cut_with_missing(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(0, 1, 400), 1)
    values[::17] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": values}))
    cut = pd.cut(pd.Series(values), bins=100, labels=range(100))
    expected = [101 if math.isnan(v) else int(c) for v, c in zip(values, cut)]
    assert codes(df, fit_right_closed(df, ["x"]), right_codes) == expected


def test_skewed_bits_ask_for_many_bins_without_edges(spark):
    df = frame(spark, [1.0] * 3 + [0.0] * 97)
    specs = fit_left_closed(df, ["x"])
    assert specs["x"].bins == auto_bins(1.0, 0.0, 100) > 10_000_000
    assert codes(df, specs, left_codes) == [specs["x"].bins - 1] * 3 + [0] * 97


@pytest.mark.parametrize("values", [[1.0, float("inf")], [1.0, None], [1.0, float("nan")]])
def test_bad_values_are_rejected(spark, values):
    with pytest.raises(ValueError):
        fit_left_closed(frame(spark, values), ["x"])


def test_text_is_not_numeric(spark):
    with pytest.raises(ValueError):
        fit_left_closed(frame(spark, ["a"], "string"), ["x"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3)), min_size=2, max_size=60))
def test_distributed_quantiles_equal_interpolated_ones(spark, values):
    df = frame(spark, values)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = exact_quantiles(df, ["x"], probs)["x"]
    assert np.allclose(found, np.percentile(values, [100 * p for p in probs]), rtol=0, atol=1e-6)


def test_distributed_quantiles_with_a_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 7.0).otherwise(F.col("id") / 3.0).alias("x"))
    values = df.toPandas()["x"]
    found = exact_quantiles(df, ["x"], [0.1, 0.5, 0.75])["x"]
    assert np.allclose(found, np.percentile(values, [10, 50, 75]))


def test_histogram_counts_empty_codes(spark):
    codes_seen = [3, 3, 5, 9, 5, 3]
    rows = code_histogram(frame(spark, codes_seen, "bigint"), "x").collect()
    assert sum(r["n"] for r in rows) == len(codes_seen)
    assert {r["empty_codes"] for r in rows} == {10 - 3}  # of the codes 0 to 9


def test_contingency_counts_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (2, 3), (2, 3)], "x bigint, y bigint")
    rows = contingency_2d(df, "x", "y").collect()
    assert {(r["x"], r["y"], r["n"]) for r in rows} == {(0, 0, 1), (2, 3, 2)}
    assert rows[0]["empty_cells"] == 3 * 4 - 2


def test_enumerated_codes_are_dense_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") % 37).cast("string").alias("x"))
    rows = enumerate_codes(df, "x").orderBy("code").collect()
    assert [r["code"] for r in rows] == list(range(37))
    assert [r["value"] for r in rows] == sorted(str(i) for i in range(37))
    assert sum(r["n"] for r in rows) == 1000
