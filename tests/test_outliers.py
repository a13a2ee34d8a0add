import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia import SequenceOutlierDetector, TabularOutlierDetector
from evidentia.operators.lof import PlaceFactors, exact_lof
from evidentia.operators.outliers import random_bags
from evidentia.operators.sequences import previous_value


def brute_lof(points, k):
    dist = np.zeros((len(points), len(points)))
    for j in range(points.shape[1]):
        delta = points[:, j][:, None] - points[:, j][None, :]
        dist += delta * delta
    dist = np.sqrt(dist)
    np.fill_diagonal(dist, np.inf)
    k_dist = np.sort(dist, axis=1)[:, k - 1]
    near = dist <= k_dist[:, None]
    lrd = np.array([1 / (np.maximum(dist[i], k_dist)[near[i]].mean() + 1e-10) for i in range(len(points))])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(points))])


def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *[f"x{j}" for j in range(points.shape[1])]])


def check_exact(spark, points, k, cell=None):
    df, names = frame(spark, points), [f"x{j}" for j in range(points.shape[1])]
    scored = exact_lof(df, names, k) if cell is None else PlaceFactors.fit(df, names, k, cell).score(df)
    found = np.array([r["lof"] for r in scored.orderBy("id").collect()])
    assert len(found) == len(points)
    assert np.allclose(found, brute_lof(points, k), rtol=1e-6)


def test_exact_factor_of_uneven_clusters(spark):
    rng = np.random.default_rng(1)
    dense = rng.normal(0, 1e-5, (150, 2))
    wide = rng.normal(50, 10, (100, 2))
    far = np.array([[1000.0, -1000.0], [0.01, 0.01]])
    check_exact(spark, np.vstack([dense, wide, far]), 4)


def test_exact_factor_with_a_hot_place_and_ties(spark):
    lattice = np.array([[i, j] for i in range(9) for j in range(9)], dtype=float)
    hot = np.repeat([[4.0, 4.0]], 90, axis=0)
    few = np.repeat([[2.0, 7.0]], 2, axis=0)
    check_exact(spark, np.vstack([lattice, hot, few]), 3)


@pytest.mark.parametrize("d", [1, 3])
def test_exact_factor_in_other_dimensions(spark, d):
    check_exact(spark, np.round(np.random.default_rng(d).normal(0, 1, (160, d)), 2), 5)


def test_exact_factor_of_equal_rows(spark):
    check_exact_one = spark.createDataFrame([(i, 1.0) for i in range(8)], "id bigint, x double")
    assert {r["lof"] for r in exact_lof(check_exact_one, ["x"], 3).collect()} == {1.0}


def test_exact_factor_limits(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id bigint, x double, y double")
    with pytest.raises(ValueError):
        exact_lof(df, ["x"], 1)
    with pytest.raises(ValueError):
        exact_lof(df, [], 1)


def test_exact_factor_on_many_columns(spark):
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(0, 1, (120, 7)), rng.normal(5, 0.1, (40, 7)), np.repeat(rng.normal(0, 1, (1, 7)), 9, axis=0)])
    points[:5, :4] = 0.0  # places that only the last columns tell apart
    check_exact(spark, points, 4)


def brute_unseen(points, fresh, k):
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    k_dist = np.sort(dist, axis=1)[:, k - 1]
    near = dist <= k_dist[:, None]
    lrd = np.array([1 / (np.maximum(dist[i], k_dist)[near[i]].mean() + 1e-10) for i in range(len(points))])
    out = []
    for q in fresh:
        d = np.sqrt(((points - q) ** 2).sum(1))
        hit = d <= np.sort(d)[k - 1]
        out.append(lrd[hit].mean() * (np.maximum(d, k_dist)[hit].mean() + 1e-10))
    return np.array(out)


@pytest.mark.parametrize("d", [1, 2, 5])
def test_rows_not_seen_are_measured_against_the_fitted_ones(spark, d):
    rng = np.random.default_rng(d)
    points = np.vstack([rng.normal(0, 1, (150, d)), rng.normal(20, 1e-3, (60, d))])
    fresh = np.vstack([rng.normal(0, 2, (25, d)), rng.normal(20, 1e-2, (10, d)), np.full((1, d), 500.0), np.full((1, d), -90.0), np.full((1, d), 10.0)])
    names = [f"x{j}" for j in range(d)]
    frame = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], ["id", *names])
    fitted = PlaceFactors.fit(frame(points), names, 4)
    found = [r["lof"] for r in fitted.score(frame(fresh)).orderBy("id").collect()]
    assert np.allclose(found, brute_unseen(points, fresh, 4), rtol=1e-6)
    again = [r["lof"] for r in fitted.score(frame(points)).orderBy("id").collect()]
    assert np.allclose(again, brute_lof(points, 4), rtol=1e-6)


def test_missing_numbers_have_no_score(spark):
    df = table_frame(spark)
    model = TabularOutlierDetector(keyCols=["id"], numericCols=["x", "y"], categoryCols=["a", "b"], knownStructure=[("a", "b")], numericParents={"x": ["a"]}, bags=[["x", "y"]]).fit(df)
    gapped = df.limit(4).withColumn("x", F.when(F.col("id") == 1, F.lit(float("nan"))).when(F.col("id") != 2, F.col("x")))
    rows = {r["id"]: r for r in model.predict(gapped).collect()}
    for i, r in rows.items():
        assert (r["score"] is None) == (r["prediction"] is None) == (i in (1, 2))


def test_a_value_off_a_constant_group_stands_out(spark):
    rows = [(i, i % 2, 5.0 if i % 2 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, a int, x double")
    model = TabularOutlierDetector(keyCols=["id"], categoryCols=["a"], knownStructure=[], numericParents={"x": ["a"]}, nodes=["a"]).fit(df)
    odd = spark.createDataFrame([(1000, 1, 5.0), (1001, 1, 90.0)], df.schema)
    scores = {r["id"]: r["bn_score"] for r in model.transform(odd).collect()}
    assert scores[1001] > scores[1000]


def test_no_cross_join_in_the_exact_factor(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(0, 1, (60, 2)))], "id bigint, x double, y double")
    plan = PlaceFactors.fit(df, ["x", "y"], 3, 8).tree.neighbours(3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def few_values_first(n=1000, seed=4):
    """Four columns of two values and one of numbers: only the last tells most rows apart."""
    rng = np.random.default_rng(seed)
    return np.hstack([rng.integers(0, 2, (n, 4)), rng.normal(0, 1, (n, 1))]).astype(float)


@pytest.mark.parametrize("cell", [None, 40])
@pytest.mark.parametrize("turned", [False, True])
def test_exact_factor_where_the_first_columns_have_few_values(spark, turned, cell):
    points = few_values_first(1000 if cell is None else 400)
    check_exact(spark, points[:, ::-1] if turned else points, 5, cell)


def heavy_value(rng):
    """A value that most places share, which quantiles alone can't split."""
    return np.vstack([np.c_[np.zeros(300), rng.normal(0, 1, 300)], np.c_[rng.normal(0, 1e-3, 40), rng.normal(0, 1, 40)], rng.normal(0, 1, (60, 2))])


@pytest.mark.parametrize("cell", [6, 40])
def test_exact_factor_over_many_small_cells(spark, cell):
    rng = np.random.default_rng(8)
    lattice = np.array([[i, j] for i in range(12) for j in range(12)], dtype=float)
    check_exact(spark, np.vstack([heavy_value(rng), lattice, np.repeat(lattice[5:6], 9, axis=0), [[900.0, -900.0]]]), 4, cell)


def test_cells_are_bounded_and_pairs_few(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(0, 1, (3000, 2)), heavy_value(rng)])
    fitted = PlaceFactors.fit(frame(spark, points), ["x0", "x1"], 5, 64)
    sizes = [r["size"] for r in fitted.tree.nodes.where("cell").collect()]
    assert max(sizes) <= 64 and sum(sizes) == len(points) == fitted.places.count()
    assert fitted.tree.neighbours(5).count() < 30 * len(points)


@pytest.mark.parametrize("cell", [None, 16])
def test_unseen_rows_over_cells(spark, cell):
    rng = np.random.default_rng(12)
    points = np.vstack([heavy_value(rng), rng.normal(8, 0.01, (80, 2))])
    fresh = np.vstack([points[:15] + 1e-4, rng.normal(0, 4, (25, 2)), [[500.0, 500.0], [-80.0, 0.0]]])
    fitted = PlaceFactors.fit(frame(spark, points), ["x0", "x1"], 4, cell)
    found = [r["lof"] for r in fitted.score(frame(spark, fresh)).orderBy("id").collect()]
    assert np.allclose(found, brute_unseen(points, fresh, 4), rtol=1e-6)


def test_rows_scored_apart_count_as_further_rows(spark):
    points = np.round(np.random.default_rng(6).normal(0, 1, (120, 3)), 1)
    fitted = PlaceFactors.fit(frame(spark, points), ["x0", "x1", "x2"], 4)
    found = [r["lof"] for r in fitted.score(frame(spark, points[:40]), apart=True).orderBy("id").collect()]
    assert np.allclose(found, brute_unseen(points, points[:40], 4), rtol=1e-6)


def table_frame(spark, n=600):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.95, a, (a + 1) % 3)
    x, y = rng.normal(a, 0.2), rng.normal(0, 1, n)
    x[0], y[0] = 40.0, 40.0
    b[0] = (a[0] + 1) % 3
    rows = [(i, int(p), int(q), float(u), float(v)) for i, (p, q, u, v) in enumerate(zip(a, b, x, y))]
    return spark.createDataFrame(rows, "id bigint, a int, b int, x double, y double")


def test_detector_finds_the_planted_row(spark):
    df = table_frame(spark)
    model = TabularOutlierDetector(
        keyCols=["id"], numericCols=["x", "y"], categoryCols=["a", "b"], knownStructure=[("a", "b")],
        numericParents={"x": ["a"]}, iterations=2, contamination=0.02, seed=1,
    ).fit(df)
    rows = model.predict(df).orderBy(F.desc("score")).collect()
    assert rows[0]["id"] == 0 and rows[0]["prediction"] == -1
    assert sum(r["prediction"] == -1 for r in rows) == 12
    assert all(0 <= r[c] <= 1 for r in rows for c in ("lof_score", "bn_score", "score"))
    decision = {r["id"]: r["decision"] for r in model.decision_function(df).collect()}
    assert decision[0] < 0 and sum(v < 0 for v in decision.values()) == 12


def test_bags_are_repeatable():
    assert random_bags(["c", "a", "b"], 2, 3, 5) == random_bags(["a", "b", "c"], 2, 3, 5)


def test_previous_value_with_a_hot_entity(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("entity"),
        F.timestamp_seconds(F.floor(F.col("id") / 4) * 7 % 5000).alias("ts"), (F.col("id") * 31 % 11).alias("state"),
    )
    plain = df.withColumn("p", F.lag("state").over(W.partitionBy("entity").orderBy("ts", "id")))
    ours = previous_value(df, "entity", ["ts", "id"], "state", "p")
    assert sorted(ours.select("id", "p").collect(), key=str) == sorted(plain.select("id", "p").collect(), key=str)


def test_sequence_detector(spark):
    # a, b, a, b ... with one c
    rows = [(e, i, "c" if (e, i) == (3, 20) else "ab"[i % 2]) for e in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "e int, i int, s string").withColumn("ts", F.timestamp_seconds(F.col("i")))
    model = SequenceOutlierDetector(entityCol="e", orderCols=["ts", "i"], stateCol="s", contamination=0.015).fit(df)
    out = model.transform(df).where("prediction = -1").collect()
    assert (3, 20) in {(r["e"], r["i"]) for r in out}
    assert len(out) <= 3


def test_asking_leaves_of_a_single_cell_are_not_kept(spark, monkeypatch):
    from evidentia.operators import tree
    from evidentia.operators.lof import PlaceFactors

    kept = []
    monkeypatch.setattr(tree, "cut_lineage", lambda df, cut=tree.cut_lineage: kept.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(i, float(i * i % 17), float(i % 5)) for i in range(60)], "id bigint, x double, y double")
    scored = PlaceFactors.fit(rows, ["x", "y"], 3).score(rows, apart=True)
    assert scored.where("lof IS NULL").count() == 0 and kept and not any("pair" in columns for columns in kept)


def wide_points(rng):
    """Independent columns, where boxes prune nothing; a cluster too tight and one too far away for single precision; places of several rows."""
    free = rng.normal(0, 1, (260, 12))
    tight = free[:1] + rng.normal(0, 1e-9, (30, 12))
    far = 1e12 + rng.normal(0, 1e3, (30, 12))
    lattice = rng.integers(0, 2, (60, 12)).astype(float)
    return np.vstack([free, tight, far, lattice, np.repeat(free[5:6], 3, axis=0), np.repeat(free[7:8], 9, axis=0), np.full((1, 12), 1e25)])


@pytest.mark.parametrize("cell", [None, 40])
def test_exact_factor_over_many_independent_columns(spark, cell):
    check_exact(spark, wide_points(np.random.default_rng(21)), 4, cell)


def test_unseen_rows_over_many_independent_columns(spark):
    rng = np.random.default_rng(22)
    points, fresh = wide_points(rng)[:-1], np.vstack([rng.normal(0, 1, (20, 12)), np.full((1, 12), 1e12)])
    fitted = PlaceFactors.fit(frame(spark, points), [f"x{j}" for j in range(12)], 4, 40)
    found = [r["lof"] for r in fitted.score(frame(spark, fresh)).orderBy("id").collect()]
    assert np.allclose(found, brute_unseen(points, fresh, 4), rtol=1e-6)


def test_leaves_move_once_for_each_group_of_cells(spark, monkeypatch):
    from evidentia.operators import tree

    kept = []
    monkeypatch.setattr(tree, "cut_lineage", lambda df, cut=tree.cut_lineage: kept.append(cut(df)) or kept[-1])
    points = np.random.default_rng(23).normal(0, 1, (1200, 12))
    PlaceFactors.fit(frame(spark, points), [f"x{j}" for j in range(12)], 3, 8)
    wanted = [df for df in kept if {"to", "from", "cell", "q"} <= set(df.columns)]
    assert len(wanted) == 1
    sent, asked = wanted[0].select("to", "cell", "q").distinct().count(), wanted[0].count()
    assert asked > 3 * sent and wanted[0].select("to").distinct().count() >= 16


def test_places_beyond_reach_are_not_measured():
    """Rows of single cells: a bound on all distances is one product, and few are measured."""
    from evidentia.operators.tree import _kernels

    rng = np.random.default_rng(24)
    kernels, x = _kernels(), rng.normal(0, 1, (2000, 64))
    order, sizes = kernels.leaves(x, 128)
    y = x[order]
    row = {"cell": "0", "ids": np.arange(2000).tobytes(), "x": y.tobytes(), "w": np.ones(2000, np.int64).tobytes(), "sizes": sizes.astype(np.int64).tobytes()}
    block = kernels.opened([row], 64)
    found = kernels.search(y[:100], np.full(100, np.inf), np.arange(100), block, 5)
    assert len(found[0]) == 500 and {kind for _, kind in block["screens"]} == {np.float32}
