import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import CausalFeatureSelector, FirstKSelector, MarkovBlanketSelector, NMIFeatureSelector
from evidentia.operators.causal_selector import binned_cells, greedy_effects
from evidentia.operators.counts import contingency
from evidentia.operators.entropy import causal_effects, conditional_entropies, entropies, nmi
from evidentia.operators.selection import SelectorModel
from tests.fixtures import RAIN, SCHEMA, SLIP, SPRINKLER, WET, column, day_rows, entropy, entropy_given


def days(spark):
    return spark.createDataFrame(day_rows(), SCHEMA)


@pytest.mark.parametrize("name", ["rain", "wet", "slip"])
def test_entropy_of_a_column(spark, name):
    assert entropies(days(spark), [name]).first()["entropy"] == pytest.approx(entropy(column(name)))


def test_conditional_entropy(spark):
    df = days(spark).withColumn("dry", 1 - F.col("wet"))
    found = conditional_entropies(df, "wet", [["dry"], ["rain"], ["rain", "sprinkler"]]).collect()
    expected = [0.0, entropy_given(WET, RAIN), entropy_given(WET, RAIN, SPRINKLER)]
    assert sorted(r["conditional_entropy"] for r in found) == pytest.approx(sorted(expected), abs=1e-12)


def test_effect_with_two_controls(spark):
    cells = contingency(days(spark), ["wet", "slip", "rain", "sprinkler"])
    row = causal_effects(cells, "slip", [("wet", ["rain", "sprinkler"])]).first()
    assert row["effect"] == pytest.approx(entropy_given(SLIP, RAIN, SPRINKLER) - entropy_given(SLIP, RAIN, SPRINKLER, WET))
    assert row["dependent"]


def test_independent_columns_have_exactly_no_effect(spark):
    df = spark.range(36).select((F.col("id") % 2).alias("x"), (F.col("id") % 3).alias("y"))
    row = causal_effects(contingency(df, ["x", "y"]), "y", [("x", [])]).first()
    assert not row["dependent"]


def plates(spark):
    """A thickness decides the grade, half of the rows have a noisy second reading, and a stamp says nothing."""
    rows = [(i % 5, (i % 5 + (i // 5) % 2) % 6, 7, int(i % 5 >= 3)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "thickness bigint, reading bigint, stamp bigint, grade bigint")


def test_causal_selector(spark):
    rows, df = plates(spark)
    model = CausalFeatureSelector(labelCol="grade").fit(df)
    assert model.get_support()[2] is False and model.get_support()[0] is True
    scores = model.getOrDefault("scores")
    assert scores[0] > 0 and scores[2] == pytest.approx(0.0)
    assert model.transform(df).columns == model.get_feature_names_out()


def test_least_effect(spark):
    _, df = plates(spark)
    every = CausalFeatureSelector(labelCol="grade").fit(df).getOrDefault("scores")
    model = CausalFeatureSelector(labelCol="grade", minEffect=max(every) - 1e-9).fit(df)
    assert model.get_feature_names_out() == ["thickness"]
    assert CausalFeatureSelector(labelCol="grade", minEffect=2.0).fit(df).get_feature_names_out() == []


def greedy_by_hand(codes, target):
    """Plain conditional entropies over row masks."""

    def h(keys, y):
        total = 0.0
        for key in set(keys):
            ys = [b for a, b in zip(keys, y) if a == key]
            p = np.unique(ys, return_counts=True)[1] / len(ys)
            total -= len(ys) / len(y) * float(np.sum(p * np.log2(p)))
        return total

    kept, out = [], []
    for c in range(codes.shape[1]):
        before = [tuple(r) for r in codes[:, kept]]
        after = [tuple(r) for r in codes[:, [*kept, c]]]
        effect = h(before, target) - h(after, target)
        on = effect > 1e-9
        out.append((effect, on))
        if on:
            kept.append(c)
    return out


def test_walk_restarts_after_a_rejected_feature(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (200, 11))
    x[:, 3] = 1  # a constant and a copy say nothing new
    x[:, 6] = x[:, 0]
    y = (x[:, 0] + x[:, 1] + rng.integers(0, 2, 200)) % 3
    names = [f"f{i}" for i in range(11)]
    df = spark.createDataFrame([[int(v) for v in (*r, t)] for r, t in zip(x, y)], [*names, "t"])
    walked = greedy_effects(contingency(df, [*names, "t"]), names, "t")
    expected = greedy_by_hand(x, y)
    assert [e.selected for e in walked] == [on for _, on in expected]
    assert [e.effect for e in walked] == pytest.approx([v for v, _ in expected], abs=1e-9)
    assert not walked[3].selected and not walked[6].selected


def test_causal_selector_rejects_missing_label(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "x bigint, t bigint")
    with pytest.raises(ValueError):
        CausalFeatureSelector(labelCol="t").fit(df)
    with pytest.raises(ValueError):
        CausalFeatureSelector(labelCol="absent").fit(df)
    with pytest.raises(ValueError):
        CausalFeatureSelector().fit(df)


def test_nmi_of_two_columns(spark):
    df = days(spark)
    joint = list(zip(RAIN, WET))
    ha, hb, hab = entropy(RAIN), entropy(WET), entropy(joint)
    row = nmi(df, [("rain", "wet")], "standard").first()
    assert (row["h_a"], row["h_b"], row["h_ab"], row["nmi"]) == pytest.approx((ha, hb, hab, (ha + hb - hab) / (2 * max(ha, hb))))
    counts = [[v.count(x) for x in (0, 1)] for v in (RAIN, WET)] + [[joint.count((a, b)) for a in (0, 1) for b in (0, 1)]]
    ha, hb, hab = (count_list_entropy(c) for c in counts)
    row = nmi(df, [("rain", "wet")], "counts").first()
    assert (row["h_a"], row["h_b"], row["h_ab"], row["nmi"]) == pytest.approx((ha, hb, hab, (ha + hb - hab) / (2 * max(ha, hb))))


def count_list_entropy(counts):
    p = np.unique(counts, return_counts=True)[1] / len(counts)
    return -float(np.sum(p * np.log2(p)))


def test_count_entropy_with_gaps_and_missing(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, 300), 1)
    y = rng.integers(0, 4, 300)
    rows = [(None if i % 20 == 0 else float(v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y int")
    lo, hi = min(v for v, _ in rows if v is not None), max(v for v, _ in rows if v is not None)
    edges = np.linspace(lo, hi, 101)
    code = np.array([101 if v is None else min(max(int(np.searchsorted(edges, v, side="left")) - 1, 0), 99) for v, _ in rows])
    table = np.zeros((102 - code.min(), 4), dtype=int)
    for c, t in zip(code, y):
        table[c - code.min(), t] += 1
    row = nmi(df, [("x", "y")], "counts").first()
    assert row["h_a"] == pytest.approx(count_list_entropy(np.bincount(code)))
    assert row["h_ab"] == pytest.approx(count_list_entropy(table.flatten()))


def test_booleans(spark):
    df = spark.createDataFrame([(True, 1), (False, 0), (True, 1), (False, 1)], "b boolean, t int")
    assert nmi(df, [("b", "t")], "standard").first()["h_a"] == pytest.approx(1.0)
    # Codes 0 and 99: two counts of two, 98 empty codes.
    assert nmi(df, [("b", "t")], "counts").first()["h_a"] == pytest.approx(count_list_entropy([2, 2] + [0] * 98))


def test_equally_frequent_categories_give_no_value(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "a int, t int")
    assert nmi(df, [("a", "t")], "counts").first()["nmi"] is None
    assert NMIFeatureSelector(labelCol="t", mode="counts").fit(df).get_feature_names_out() == []


def test_nmi_selector_takes_signal_and_leaves_noise(spark):
    rng = np.random.default_rng(21)
    t = rng.integers(0, 2, 500)
    signal = t * 3.0 + rng.random(500)
    noise = rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(a > 2), int(b), int(c)) for a, b, c in zip(signal, noise, t)], "signal int, noise int, t int")
    kept = NMIFeatureSelector(labelCol="t", threshold=0.1).fit(df)
    scores = {c: nmi_by_hand(np.array([r[0] for r in df.select(c).collect()]), t) for c in ("signal", "noise")}
    assert scores["signal"] > 0.4 and scores["noise"] < 0.1
    assert set(kept.get_feature_names_out()) <= {"signal"}


def nmi_by_hand(a, b):
    def h(v):
        p = np.unique(v, return_counts=True, axis=0)[1] / len(v)
        return -float(np.sum(p * np.log2(p)))

    ha, hb, hab = h(a), h(b), h(np.c_[a, b])
    return (ha + hb - hab) / (2 * max(ha, hb)) if max(ha, hb) > 0 else math.nan


def test_nmi_selector_two_stages(spark):
    rng = np.random.default_rng(8)
    t = rng.integers(0, 3, 400)
    a = np.where(rng.random(400) < 0.9, t, rng.integers(0, 3, 400))
    b = np.where(rng.random(400) < 0.8, a, rng.integers(0, 3, 400))
    c = rng.integers(0, 3, 400)
    cols = {"a": a, "b": b, "c": c}
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(a, b, c, t)], "a int, b int, c int, t int")
    with pytest.raises(ValueError):
        NMIFeatureSelector(labelCol="t").fit(df)
    score = {k: nmi_by_hand(v, t) for k, v in cols.items()}
    relevant = [k for k in cols if score[k] > 0.05]
    dominant = [
        k for k in relevant if any(j != k and score[k] > score[j] and nmi_by_hand(cols[k], cols[j]) > score[j] for j in cols)
    ]
    model = NMIFeatureSelector(labelCol="t", threshold=0.05).fit(df)
    assert model.get_feature_names_out() == dominant
    alone = NMIFeatureSelector(labelCol="t", threshold=(score["a"] + score["b"]) / 2).fit(df)
    assert alone.get_feature_names_out() == ["a"]


def test_first_two_columns_and_inverse(spark, tmp_path):
    _, df = plates(spark)
    model = FirstKSelector().fit(df)
    first = ["thickness", "reading"]
    assert model.transform(df).columns == first
    back = model.inverse_transform(model.transform(df))
    assert back.columns == df.columns and back.dtypes == df.dtypes
    assert back.agg(F.sum("stamp")).first()[0] == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    assert SelectorModel.load(str(tmp_path / "m")).get_feature_names_out() == first
    assert [(r["feature"], r["selected"]) for r in model.support(spark).collect()] == [(c, c in first) for c in df.columns]


def test_markov_blanket_selector(spark):
    rng = np.random.default_rng(4)
    a, noise = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    t = np.where(rng.random(2000) < 0.9, a, 1 - a)
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(zip(a, noise, t))], "id bigint, a int, noise int, t int")
    model = MarkovBlanketSelector(featureCols=["a", "noise"], labelCol="t", seed=1).fit(df)
    assert model.get_feature_names_out() == ["a"]


def test_one_shuffle_of_the_rows_for_all_features(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 2).alias("t"))
    plan = nmi(df, [("a", "t"), ("b", "t")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Python" not in plan


def test_cells_are_counted_once(spark):
    rows, df = plates(spark)
    cells = binned_cells(df, ["thickness", "reading", "stamp"], "grade")
    assert cells.agg(F.sum("n")).first()[0] == len(rows)
