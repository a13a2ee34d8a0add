import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia import AverageCausalEffect, ClassBalancer, SyntheticGenerator, UnitImportance
from evidentia.functions.running import numbered, running_sums
from evidentia.functions.sampling import bottom_k, hash_split, nested_sample
from evidentia.operators.ace import moments
from evidentia.operators.balance import class_imbalance
from evidentia.operators.cpt import fit_network
from evidentia.operators.layers import response_norms
from evidentia.operators.mixture import choose_mixtures, fit_mixtures
from evidentia.operators.models import rank_consistency
from evidentia.operators.synth import SyntheticModel
from evidentia.sources.tables import as_table, attach_target, load_table, split_target


def frame(spark, n=900, parts=4):
    return spark.range(0, n, numPartitions=parts).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("t"),
        F.when(F.col("id") % 10 == 0, F.lit("x")).otherwise(F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int"))).alias("c"),
        (F.col("id") % 7 + F.when(F.col("id") % 10 == 0, 50).otherwise(0)).cast("double").alias("x"),
    )


def test_sample_follows_the_network(spark):
    df = frame(spark)
    model = SyntheticGenerator(featureCols=["t", "c"], knownStructure=[("t", "c")], numericParents={"x": ["t"]}).fit(df)
    made = model.sample(4000, seed=2)
    assert made.columns == ["id", "t", "c", "x"] and made.count() == 4000
    share = made.agg(F.avg("t")).first()[0]
    assert share == pytest.approx(0.1, abs=0.02)
    means = {r["t"]: r["m"] for r in made.groupBy("t").agg(F.avg("x").alias("m")).collect()}
    assert means[1] == pytest.approx(53, abs=0.5) and means[0] == pytest.approx(3, abs=0.2)
    assert made.schema["t"].dataType == df.schema["t"].dataType


def test_sample_does_not_depend_on_partitions(spark):
    model = SyntheticGenerator(featureCols=["t", "c"], knownStructure=[("t", "c")]).fit(frame(spark))
    one = model._transform(spark.range(0, 300, numPartitions=1), 5)
    many = model._transform(spark.range(0, 300, numPartitions=7), 5)
    assert sorted(one.collect()) == sorted(many.collect())


def test_generator_saves_and_loads(spark, tmp_path):
    model = SyntheticGenerator(featureCols=["t", "c"], knownStructure=[("t", "c")], numericParents={"x": ["t"]}, components=2).fit(frame(spark))
    model.save(str(tmp_path / "g"))
    again = SyntheticModel.load(spark, str(tmp_path / "g"))
    assert sorted(again.sample(50, 1).collect()) == sorted(model.sample(50, 1).collect())


def test_mixture_finds_two_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(0, float(v)) for v in [*rng.normal(0, 1, 400), *rng.normal(20, 2, 200)]]
    rows += [(1, float(v)) for v in rng.normal(10, 1, 300)]
    df = spark.createDataFrame(rows, "k int, x double")
    fitted = {r["k"]: r for r in fit_mixtures(df, "x", ["k"], 2, 20).collect()}
    assert fitted[0]["means"] == pytest.approx([0, 20], abs=0.5)
    assert fitted[0]["weights"] == pytest.approx([2 / 3, 1 / 3], abs=0.02)
    assert sum(fitted[1]["weights"]) == pytest.approx(1.0)
    whole = fit_mixtures(df, "x", [], 1, 1).first()
    assert whole["means"][0] == pytest.approx(np.mean([v for _, v in rows]))


def test_components_are_chosen_by_group(spark):
    rng = np.random.default_rng(0)
    rows = [(0, float(v)) for v in [*rng.normal(0, 1, 400), *rng.normal(20, 2, 200)]] + [(1, float(v)) for v in rng.normal(10, 1, 300)]
    rows += [(2, 5.0)] * 40 + [(3, None)] * 3
    df = spark.createDataFrame(rows, "k int, x double")
    found = {r["k"]: r for r in choose_mixtures(df, "x", ["k"], 3, 30).collect()}
    assert {k: r["components"] for k, r in found.items()} == {0: 2, 1: 1, 2: 1}
    assert [len(found[0][c]) for c in ("weights", "means", "sds")] == [2, 2, 2] and found[0]["means"] == pytest.approx([0, 20], abs=0.5)
    x = np.array([v for k, v in rows if k == 1])
    likelihood = -0.5 * len(x) * (np.log(2 * np.pi * x.var()) + 1)
    assert found[1]["bic"] == pytest.approx(-2 * likelihood + 2 * np.log(len(x)))
    whole = choose_mixtures(df, "x", [], 2).first()
    assert whole["components"] == 2 and whole["n"] == 940
    model = SyntheticGenerator(featureCols=["k"], knownStructure=[], numericParents={"x": ["k"]}, components=0).fit(df.where("k < 3"))
    made = model.sample(900, seed=4)
    assert made.where("x IS NULL").count() == 0
    near = made.where("k = 0").agg(F.avg((F.col("x") > 10).cast("int"))).first()[0]
    assert near == pytest.approx(1 / 3, abs=0.08)


def test_balancing(spark):
    df = frame(spark)
    out = ClassBalancer(featureCols=["c"], labelCol="t", knownStructure=[("t", "c")], numericParents={"x": ["t"]}, seed=1).fit_resample(df)
    counts = {(r["t"], r["synthetic"]): r["count"] for r in out.groupBy("t", "synthetic").count().collect()}
    assert counts == {(0, False): 810, (1, False): 90, (1, True): 720}
    kept = out.where("not synthetic").select("t", "c", "x")
    assert sorted(kept.collect()) == sorted(df.select("t", "c", "x").collect())
    # The minority class is nearly always x.
    assert out.where("synthetic and c = 'x'").count() > 650
    with pytest.raises(ValueError):
        ClassBalancer(featureCols=["c"], labelCol="t", knownStructure=[("c", "t")]).fit_resample(df)


def test_imbalance(spark):
    rows = {r["class"]: r for r in class_imbalance(frame(spark), "t").collect()}
    assert rows[1]["minority"] and not rows[0]["minority"]
    assert rows[1]["ratio"] == pytest.approx(90 / 810)


def test_hash_samples_are_nested_and_repeatable(spark):
    df = spark.range(0, 2000, numPartitions=3)
    small = {r["id"] for r in nested_sample(df, ["id"], 0.1, 1).collect()}
    large = {r["id"] for r in nested_sample(df.repartition(8), ["id"], 0.2, 1).collect()}
    assert small < large and 120 < len(small) < 280
    train, test = hash_split(df, ["id"], 0.7, 42)
    assert train.count() + test.count() == 2000
    assert bottom_k(df, ["id"], 17, 3).count() == 17


def test_effects_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (400, 3))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([[*map(float, r), float(t)] for r, t in zip(x, y)], ["a", "b", "c", "y"])
    model = AverageCausalEffect(treatments=["a", "b"], outcome="y", adjustment=["c"]).fit(df)
    expected = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
    assert [model.effects["a"], model.effects["b"]] == pytest.approx(expected[:2].tolist(), abs=1e-6)
    signs = {r["treatment"]: r["direction"] for r in model.table(spark).collect()}
    assert signs == {"a": "increases", "b": "reduces"}
    placebo = model.placebo(df.withColumn("id", F.monotonically_increasing_id()), ["id"], runs=4, seed=1).collect()
    # Four standard errors of a slope on a uniform treatment.
    bound = 4 * y.std() / (np.sqrt(1 / 12) * np.sqrt(400))
    assert len(placebo) == 4 and all(abs(r["effect"]) < bound for r in placebo)


def test_wide_moments_equal_narrow_ones(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(100, 1, (150, 30))
    names = [f"v{i}" for i in range(30)]
    df = spark.createDataFrame([list(map(float, r)) for r in x], names).repartition(5)
    found = moments(df, names)  # 465 pairs
    assert np.allclose(found.cov, np.cov(x.T, bias=True)) and np.allclose(found.mean, x.mean(axis=0))


def test_norm_of_nested_blocks(spark):
    df = spark.createDataFrame([(1, "l", 0, [[3.0, 0.0], [0.0, 4.0]])], "sample_id int, layer string, unit int, response array<array<float>>")
    assert response_norms(df).first()["norm"] == pytest.approx(5.0)


def test_unit_importance_equals_ablation(spark):
    rng = np.random.default_rng(9)
    n, units = 80, [3, 2, 2]
    norms = [np.abs(rng.normal(2, 1, (n, u))) for u in units]
    norms[1] = np.abs(norms[0] @ np.array([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]]) + rng.normal(0, 0.1, (n, 2)))
    rows = [
        (s, f"l{i}", u, [float(norms[i][s, u])]) for i in range(3) for s in range(n) for u in range(units[i])
    ]
    df = spark.createDataFrame(rows, "sample_id int, layer string, unit int, response array<double>")
    model = UnitImportance(layers=["l0", "l1", "l2"]).fit(df)
    coefs = []
    for i in (1, 2):
        design = np.c_[norms[i - 1], np.ones(n)]
        coefs.append(np.linalg.lstsq(design, norms[i], rcond=None)[0])

    def predict(x, start):
        for c in coefs[start:]:
            x = np.c_[x, np.ones(len(x))] @ c
        return x

    assert model.mse(df).first()["mse"] == pytest.approx(float(np.mean((predict(norms[0], 0) - norms[2]) ** 2)))
    found = {(r["layer"], r["unit"]): r["importance"] for r in model.importance(df).collect()}
    assert len(found) == 5
    for (layer, unit), value in found.items():
        i = int(layer[1])
        cut = norms[i].copy()
        cut[:, unit] = 0
        assert value == pytest.approx(float(np.abs(predict(norms[i], i) - predict(cut, i)).mean()))
    top = model.top(df, 2).collect()
    assert [r["importance"] for r in top] == sorted(found.values(), reverse=True)[:2]


def test_csv_source_and_target(spark, tmp_path):
    path = str(tmp_path / "data.csv")
    with open(path, "w") as f:
        f.write("a,b,target\n1,2.5,x\n2,3.5,y\n")
    df = load_table(spark, path, "csv")
    assert [t for _, t in df.dtypes] == ["int", "double", "string"]
    features, target = split_target(df, "target")
    assert features.columns == ["a", "b"] and target.columns == ["target"]
    assert attach_target(features, df.select("a", "target"), "a").count() == 2
    longer = features.union(features.selectExpr(*["a + 100 AS a" if c == "a" else c for c in features.columns]))
    assert attach_target(longer, df.select("a", "target"), "a", how="inner").count() == 2
    targets = df.select("a", "target")
    for left, right, how in ((longer, targets, "exact"), (features, targets.limit(1), "exact"), (features, targets.union(targets), "inner")):
        with pytest.raises(ValueError):
            attach_target(left, right, "a", how=how)
    assert as_table(spark, [(1, 2)], ["a", "b"]).columns == ["a", "b"] and as_table(spark, df) is df
    with pytest.raises(ValueError):
        split_target(df, "none")


def test_evidence_below_missing_ancestors_is_rejected(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    model = SyntheticGenerator(featureCols=["a", "b"], knownStructure=[("a", "b")]).fit(df)
    with pytest.raises(ValueError):
        model._transform(spark.range(10).withColumn("b", F.lit(1)))
    assert model._transform(spark.range(10).withColumn("a", F.lit(1))).count() == 10


def test_many_classes_are_balanced(spark):
    rows = [(f"c{i:03}", i % 3) for i in range(300) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "label string, x int")
    out = ClassBalancer(featureCols=["x"], labelCol="label", knownStructure=[("label", "x")]).fit_resample(df)
    assert {r["count"] for r in out.groupBy("label").count().collect()} == {3}
    assert out.where("synthetic").count() == 900 - len(rows)


def sparse_and_dense(spark, limit=1):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, 500)
    b = a * 10 + rng.integers(0, 6, 500)
    c = (b * 7 + rng.integers(0, 3, 500) * (a + 1)) % 50
    df = spark.createDataFrame(list(zip(a.tolist(), map(str, b.tolist()), c.tolist())), "a int, b string, c int")
    edges = [("a", "b"), ("a", "c"), ("b", "c")]
    return df, [fit_network(df, df.columns, edges, max_cells=m) for m in (10**6, limit)]


def test_sampling_from_large_tables_equals_that_from_small_ones(spark):
    df, (dense, sparse) = sparse_and_dense(spark)
    one, other = (SyntheticModel(net, {}).sample(6000, 5).orderBy("id").collect() for net in (dense, sparse))
    assert [tuple(r) for r in one] == [tuple(r) for r in other]
    assert {(r.a, r.b, r.c) for r in one} - {tuple(r) for r in df.collect()}  # combinations that never occurred as well


def test_evidence_for_large_tables(spark):
    """Null and unknown parents give no value; combinations that never occurred draw from all states."""
    _, (dense, sparse) = sparse_and_dense(spark)
    given = spark.range(400).select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 4).cast("int").alias("a"), F.when(F.col("id") % 3 == 0, "25").when(F.col("id") % 3 == 1, "none").otherwise("3").alias("b"))
    one, other = (SyntheticModel(net, {})._transform(given, 3).orderBy("id").collect() for net in (dense, sparse))
    assert [r.asDict() for r in one] == [r.asDict() for r in other]
    assert {r.c is None for r in one if r.a is None or r.b == "none" or r.a == 3} == {True}
    assert len({r.c for r in one if r.a == 0 and r.b == "25"}) > 5


def test_running_sums_over_one_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 2000).alias("o"), (F.col("id") % 4).alias("x"))
    plain = df.withColumn("s", F.sum("x").over(W.partitionBy("g").orderBy("o").rowsBetween(W.unboundedPreceding, W.currentRow)))
    assert sorted(map(tuple, running_sums(df, ["g"], ["o"], {"s": F.col("x")}).collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(r.i for r in numbered(df, ["o"], "i").collect()) == list(range(2000))


def test_models_that_all_err_alike_have_no_rank_correlation(spark):
    rows = [(i, "x", 4, int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, kind string, size int, label int")
    found = rank_consistency(df, df, ["kind"], ["size"], "label", key=["id"]).collect()
    assert len(found) == 5 and {(r["rank_real"], r["rank_synthetic"], r["spearman"]) for r in found} == {(1, 1, None)}


def test_large_tables_draw_a_parent_once(spark, monkeypatch):
    from evidentia.operators import synth

    df = spark.createDataFrame([(i % 3, i % 7, i % 5) for i in range(200)], "a int, b int, c int")
    model = SyntheticGenerator(featureCols=["a", "b", "c"], knownStructure=[("a", "b"), ("b", "c")], maxCells=1).fit(df)
    plans = []
    join = synth.split_join
    monkeypatch.setattr(synth, "split_join", lambda rows, *rest: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or join(rows, *rest))
    made = model.sample(300, 5)
    # rows whose parents are counted stand in a table: no draw before runs again
    assert made.count() == 300 and len(plans) == 5 and [p.count("Join") for p in plans[1::2]] == [0, 0]


@pytest.mark.parametrize("few", [0, 1000])
def test_cut_combinations_draw_as_whole_ones(spark, monkeypatch, few):
    """Cells of a combination that are added up in several parts, in more buckets than others have, broadcast or not."""
    from evidentia.operators import synth

    for name, value in (("CHUNK", 4), ("PER_BUCKET", 1), ("MANY_STATES", 2), ("LEAST_BUCKETS", 2), ("FEW_COMBINATIONS", few)):
        monkeypatch.setattr(synth, name, value)
    _, (dense, sparse) = sparse_and_dense(spark)
    one, other = (SyntheticModel(net, {}).sample(3000, 8).orderBy("id").collect() for net in (dense, sparse))
    assert [tuple(r) for r in one] == [tuple(r) for r in other]


def test_large_tables_leave_little_on_disk(spark, monkeypatch, tmp_path):
    """Of a fit and a draw stay the table, the drawn rows and the states' numbers; cells are not kept once more for every step."""
    from evidentia import session

    monkeypatch.setattr(session, "scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}-{np.random.default_rng().integers(1 << 60)}"))
    cells = 4000
    df = spark.range(cells).select((F.col("id") % 40).alias("a"), (F.col("id") * 7919 % 2003).alias("b"))
    model = SyntheticGenerator(featureCols=["a", "b"], knownStructure=[("a", "b")], maxCells=1).fit(df)
    made = model.sample(cells, 5)
    assert made.distinct().count() == cells
    kept = sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir() if any(x.name.endswith(".parquet") for x in p.iterdir()))
    assert kept < 2003 + 5 * cells  # 28,347 before
