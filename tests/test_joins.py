"""The join that keeps frequent keys where they are."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators.joins import key_counts, split_join


def sides(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("a key"), (F.col("id") % 2).alias("b"))
    side = spark.createDataFrame([("hot", 0, 1.0), ("hot", 1, 2.0), *[(f"k{i}", i % 2, float(i)) for i in range(0, 400)]], "`a key` string, b bigint, value double")
    return rows, side


@pytest.mark.parametrize("hot_bytes", [1 << 20, 10])
@pytest.mark.parametrize("given", [False, True])
def test_equals_plain_left_join(spark, hot_bytes, given):
    rows, side = sides(spark)
    keys = ["a key", "b"]
    expected = sorted(map(str, rows.join(side, keys, "left").select("id", "a key", "b", "value").collect()))
    counts = key_counts(rows, keys) if given else None
    got = split_join(rows, side, keys, counts, 0.1, hot_bytes)
    assert got.columns == ["id", "a key", "b", "value"]
    assert sorted(map(str, got.collect())) == expected


def test_hot_rows_spread_evenly(spark):
    """With 80 % of the rows on one key and more nulls, no task of the exchange gets three times the median."""
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 < 8, 7).when(F.col("id") % 10 == 9, F.col("id")).alias("k"))
    side = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = split_join(rows, side, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        found = joined.where("v = 2 * k").count()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(sizes) == 8 and max(sizes) <= 3 * sorted(sizes)[4]
    assert found == 36_000 and joined.where("k IS NULL AND v IS NULL").count() == 4_000


def test_maps_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (None, {}), (2, None)], "k int, m map<string,int>")
    side = spark.createDataFrame([(1, "one")], "k int, name string")
    got = sorted((r.k is None, r.k or 0, r.name or "") for r in split_join(rows, side, ["k"], share=0.4).collect())
    assert got == [(False, 1, "one"), (False, 1, "one"), (False, 2, ""), (True, 0, "")]


def test_empty_and_clashes(spark):
    rows, side = sides(spark)
    keys = ["a key", "b"]
    assert split_join(rows.limit(0), side, keys).count() == 0
    assert split_join(rows, side.limit(0), keys).where("value IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        split_join(rows, side, ["a key"])


def test_no_row_moves_where_every_key_is_frequent(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 1, F.col("id") % 4).alias("k"))
    side = spark.createDataFrame([(i, float(i)) for i in range(1, 2000)], "k bigint, v double")
    joined = split_join(rows, side, ["k"])
    expected = sorted(map(str, rows.join(side, ["k"], "left").select("id", "k", "v").collect()))
    assert sorted(map(str, joined.collect())) == expected
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2  # of the frequent keys with the side, and of the rows with these
