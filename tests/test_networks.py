from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import MarkovBlanketSelector, NetworkFeatureGenerator
from evidentia.operators.blanket import BlanketSearch, critical_value
from evidentia.operators.bn_features import NetworkFeatureModel
from evidentia.operators.cpt import fit_network
from evidentia.operators.families import cardinalities, compress, named_bic_scores, network_score
from evidentia.operators.ace import adjustment_columns
from evidentia.operators.graph import backdoor_set, connected, descendants, topological
from evidentia.operators.inference import with_probabilities
from evidentia.operators.structure import SetCounts, _Scores, learn_structure
from evidentia.streaming.scoring import score_stream
from tests.fixtures import CHAIN, DAYS, NODES, SCHEMA, SLIP, WET, bdeu, bic, day_rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(day_rows(), SCHEMA)


@pytest.fixture(scope="module")
def model(df):
    return NetworkFeatureGenerator(featureCols=NODES, labelCol="slip", knownStructure=CHAIN).fit(df)


def table(network, node):
    parents = network.parents[node]
    return {tuple(r[c] for c in (*parents, node)): r["prob"] for r in network.node_table(node).collect()}


def table_of(df):
    return {tuple(r[:-2]): r["prob"] for r in df.collect()}


def test_tables(model):
    n = model.network
    assert table(n, "rain") == pytest.approx(bdeu("rain", []))
    assert table(n, "sprinkler") == pytest.approx(bdeu("sprinkler", ["rain"]))
    assert table(n, "wet") == pytest.approx(bdeu("wet", ["sprinkler"]))


def test_known_structure_classes_and_variables(model):
    assert model.edges == CHAIN and model.variables == NODES and model.num_classes == len(set(SLIP))


def test_features(df, model):
    rows = model.features(df.orderBy("row_id")).collect()
    assert len(rows) == DAYS
    assert list(rows[0].asDict()) == [f"lambda_{c}" for c in NODES]
    p = {"rain": bdeu("rain", []), "sprinkler": bdeu("sprinkler", ["rain"]), "wet": bdeu("wet", ["sprinkler"])}
    for r in model.transform(df).collect():
        expected = p["rain"][(r["rain"],)], p["sprinkler"][(r["rain"], r["sprinkler"])], p["wet"][(r["sprinkler"], r["wet"])]
        assert tuple(r[f"lambda_{c}"] for c in NODES) == pytest.approx(expected)


def test_missing_value_touches_its_own_cells_only(df, model):
    gapped = df.withColumn("rain", F.when(F.col("row_id") != 7, F.col("rain")))
    whole = {r["row_id"]: r for r in model.transform(df).collect()}
    for r in model.transform(gapped).collect():
        same = NODES[2:] if r["row_id"] == 7 else NODES
        assert [r[f"lambda_{c}"] for c in same] == [whole[r["row_id"]][f"lambda_{c}"] for c in same]
        if r["row_id"] == 7:
            assert (r["lambda_rain"], r["lambda_sprinkler"]) == (0.5, 0.5)


def test_absent_parent_is_summed_out(df, model):
    first, second, third = bdeu("rain", []), bdeu("sprinkler", ["rain"]), bdeu("wet", ["sprinkler"])
    sprinkler = {s: sum(first[(a,)] * second[(a, s)] for a in (0, 1)) for s in (0, 1)}
    wet = {w: sum(sprinkler[s] * third[(s, w)] for s in (0, 1)) for w in (0, 1)}
    rows = model.transform(df.drop("sprinkler")).collect()
    assert {r["lambda_sprinkler"] for r in rows} == {0.5}
    for r in rows:
        assert r["lambda_wet"] == pytest.approx(wet[r["wet"]])


def test_absent_parent_of_several(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 2, (300, 4))]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    network = fit_network(df, list("abcd"), edges)
    p = {c: table(network, c) for c in "abcd"}
    found = {(r["c"], r["d"]): r["lambda_d"] for r in with_probabilities(df.select("c", "d"), network, ["d"]).distinct().collect()}
    for (c, d), value in found.items():
        joint = {
            y: sum(p["a"][(a,)] * p["b"][(a, b)] * p["c"][(a, c)] * p["d"][(b, c, y)] for a in (0, 1) for b in (0, 1)) for y in (0, 1)
        }
        assert value == pytest.approx(joint[d] / sum(joint.values()))


def test_unseen_combination_is_uniform_dense_and_sparse(spark):
    df = spark.createDataFrame([("x", "u", 1), ("x", "v", 2), ("y", "u", 1), ("y", "u", 3)], "a string, b string, c int")
    edges = [("a", "c"), ("b", "c")]
    rows = spark.createDataFrame(
        [("x", "u", 1), ("y", "v", 2), ("x", "u", 3), ("z", "u", 1), ("x", "u", 9), (None, "u", 1)], df.schema
    )
    dense = fit_network(df, ["a", "b", "c"], edges)
    sparse = fit_network(df, ["a", "b", "c"], edges, max_cells=1)
    assert not sparse.is_dense("c") and dense.is_dense("c")
    assert sparse.node_table("c").count() < sparse.complete_table("c").count() == 2 * 2 * 3
    assert table_of(sparse.complete_table("c")) == pytest.approx(table_of(dense.complete_table("c")))
    assert table_of(sparse.complete_table("a")) == pytest.approx(table_of(dense.node_table("a")))
    one = sorted(with_probabilities(rows, dense, num_classes=4).collect(), key=str)
    other = sorted(with_probabilities(rows, sparse, num_classes=4).collect(), key=str)
    for r, s in zip(one, other):
        assert r[:3] == s[:3] and r[3:] == pytest.approx(s[3:])
    by_key = {r[:3]: r["lambda_c"] for r in one}
    assert by_key[("y", "v", 2)] == pytest.approx(1 / 3)
    assert by_key[("z", "u", 1)] == by_key[("x", "u", 9)] == 0.25


def test_cells_of_a_large_table_are_laid_out_after_the_joins(spark, monkeypatch):
    monkeypatch.setattr("evidentia.operators.cpt.STATES_PER_LIST", 3)
    rows = [(f"p{i % 7}", i % 5, i * i % 23 if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame([*rows, ("p0", None, 1), (None, 2, 2), ("p1", 1, 40)], "a string, b int, c int")
    edges = [("a", "c"), ("b", "c"), ("a", "b")]
    dense = fit_network(df, ["a", "b", "c"], edges)
    sparse = fit_network(df, ["a", "b", "c"], edges, max_cells=1)
    for node in ("a", "b", "c"):
        cells = sparse.complete_table(node)
        assert sorted(map(tuple, cells.select("n", node).collect())) == sorted(map(tuple, dense.node_table(node).select("n", node).collect()))
        assert cells.count() == dense.cells(node) and table_of(cells) == pytest.approx(table_of(dense.node_table(node)))
    plan = sparse.complete_table("c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def diamond(spark, n=400):
    """a -> b, a -> c, (b, c) -> d, d -> e with several states, of which many combinations never occur."""
    import random

    rng = random.Random(3)
    rows = []
    for _ in range(n):
        a = rng.choice([0, 0, 1, 2])
        b, c = (a + rng.choice([0, 0, 1])) % 5, rng.choice([a, 3])
        d = (b * c + rng.choice([0, 1])) % 7
        rows.append((a, b, c, d, (d + rng.choice([0, 0, 2])) % 6))
    return spark.createDataFrame(rows, "a int, b int, c int, d int, e int"), [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]


@pytest.mark.parametrize("absent, limit", [(["b"], 1), (["b", "c"], 1), (["c"], 20), (["d"], 1), (["a"], 1), (["d", "a"], 12)])
def test_summing_out_large_tables(spark, absent, limit):
    df, edges = diamond(spark)
    dense, sparse = (fit_network(df, df.columns, edges, max_cells=m) for m in (10**6, limit))
    assert not all(sparse.is_dense(c) for c in df.columns)
    rows = df.limit(60).unionByName(spark.createDataFrame([(4, 4, 3, 6, 5), (0, None, 1, 2, 3), (9, 1, 9, 1, 9)], df.schema)).drop(*absent)
    one, other = (sorted(with_probabilities(rows, net, num_classes=4).collect(), key=str) for net in (dense, sparse))
    for r, s in zip(one, other):
        assert tuple(r) == pytest.approx(tuple(s), abs=1e-12)


def test_rows_of_every_table_sum_to_one(spark, model):
    sums = model.network.cpt.groupBy("node", "pa").agg(F.sum("prob").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_scores(df):
    counts = compress(df, NODES)
    cards = cardinalities(counts, NODES)
    families = [("rain", ()), ("sprinkler", ("rain",)), ("wet", ("sprinkler",)), ("wet", ("rain", "sprinkler")), ("wet", ())]
    found = {(r["node"], r["parents"]): r["score"] for r in named_bic_scores(counts, families, cards).collect()}
    assert sorted(found.values()) == pytest.approx(sorted(bic(c, p) for c, p in families))
    total = sum(bic(c, p) for c, p in families[:3]) - 0.1 * 2
    assert network_score(counts, families[:3], cards).first()["score"] == pytest.approx(total)


def gappy(spark):
    rows = [(i % 3, None if i % 11 == 0 else (i * i) % 4, (i % 3 + i % 2) % 3, None if i % 7 == 0 else i % 5) for i in range(600)]
    return spark.createDataFrame(rows, "a int, b int, c int, d int")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_statistics_of_sets_give_the_scores_of_families(spark, monkeypatch, limit):
    """Families share what is counted of their columns; missing values and small margins change nothing."""
    monkeypatch.setattr(SetCounts, "MARGIN_ROWS", limit)
    monkeypatch.setattr(SetCounts, "MARGIN_COLUMNS", 2)
    df = gappy(spark)
    counts = compress(df, df.columns)
    cards = cardinalities(counts, df.columns)
    families = [(c, p) for c in df.columns for k in (0, 1, 2, 3) for p in combinations([x for x in df.columns if x != c], k)]
    expected = {(r["node"], r["parents"]): r["score"] for r in named_bic_scores(counts, families, cards).collect()}
    scores = _Scores(counts.withColumn("entered", F.lit(3)), cards, df.columns)
    scores.fetch(families)
    assert scores.jobs == 1 and (len(scores.counts.margins) == 1 if limit else len(scores.counts.margins) > 3)
    for c, p in families:
        assert scores.family(3, (c, p)) == pytest.approx(expected[c, ",".join(p)], rel=1e-9)
        assert scores.family(0, (c, p)) == 0.0


def planted(spark, n=4000):
    """a and s are causes of c, c of d, a of e, and z stands apart: the blanket of a is c, e and the spouse s."""
    import random

    rng = random.Random(5)
    rows = []
    for _ in range(n):
        a, s = rng.randrange(2), rng.randrange(2)
        c = rng.choice([a, a ^ s, a ^ s, a ^ s, rng.randrange(2)])
        rows.append((a, s, c, c if rng.random() < 0.9 else rng.randrange(2), a if rng.random() < 0.85 else rng.randrange(2), rng.randrange(3)))
    return spark.createDataFrame(rows, "a int, s int, c int, d int, e int, z int")


def test_blanket_by_tests_holds_the_spouse(spark):
    df = planted(spark)
    model = MarkovBlanketSelector(labelCol="a").fit(df)
    assert model.get_feature_names_out() == ["s", "c", "e"]
    assert model.transform(df).columns == ["s", "c", "e"]
    search = BlanketSearch(df, "a", ["s", "c", "d", "e", "z"])
    assert search.find() == ["s", "c", "e"]
    assert any(t.feature == "s" and not t.given and t.ratio <= 1 for t in search.tests)  # independent alone
    with pytest.raises(ValueError, match="method"):
        MarkovBlanketSelector(labelCol="a", method="guess").fit(df)


def test_critical_values():
    """Against the table of the chi-square distribution, level 0.01."""
    for freedom, value in ((1, 6.635), (2, 9.210), (5, 15.086), (10, 23.209), (30, 50.892), (100, 135.807)):
        assert critical_value(freedom, 0.01) == pytest.approx(value, rel=0.02)


def test_tests_without_enough_rows_say_nothing(spark):
    df = spark.createDataFrame([(i % 2, i % 2, i) for i in range(30)], "t int, x int, wide int")
    assert BlanketSearch(df, "t", ["x", "wide"]).find() == ["x"]
    empty = BlanketSearch(df.limit(0), "t", ["x", "wide"])
    assert empty.find() == []


def test_learned_network(df):
    model = NetworkFeatureGenerator(featureCols=NODES, blackList=[("rain", "wet")], iterations=12).fit(df)
    assert model.num_classes is None
    assert ("rain", "wet") not in model.edges
    topological(NODES, model.edges)
    assert model.features(df).count() == DAYS


def dependent(spark, parts):
    return spark.range(0, 4000, numPartitions=parts).select(
        "id", (F.col("id") % 3).alias("a"),
        F.when(F.col("id") % 7 < 5, F.col("id") % 3).otherwise(F.col("id") % 2).alias("b"),
        (F.col("id") % 5).alias("c"),
    )


def test_search_is_repeatable_and_never_below_its_start(spark):
    found = [learn_structure(dependent(spark, p), ["a", "b", "c"], iterations=20, seed=3) for p in (1, 8)]
    assert found[0].edges == found[1].edges
    assert found[0].score == pytest.approx(found[1].score)
    assert found[0].score >= found[0].forest_score
    assert {frozenset(e) for e in found[0].edges} == {frozenset(("a", "b"))}


def test_reversing_a_lone_edge_is_no_improvement(spark):
    runs = [learn_structure(dependent(spark, p), ["a", "b"], iterations=40, seed=s) for p, s in ((2, 5), (5, 5))]
    assert runs[0].edges == runs[1].edges == runs[0].forest


def test_no_iterations_give_the_forest(spark):
    found = learn_structure(dependent(spark, 2), ["a", "b", "c"], iterations=0, seed=3)
    assert found.edges == found.forest and len(found.edges) == 2


def test_everything_black_listed(df):
    black = [(a, b) for a in NODES for b in NODES if a != b]
    model = NetworkFeatureGenerator(featureCols=NODES, blackList=black, iterations=8).fit(df)
    assert model.edges == [] and model.features(df).count() == DAYS


def test_single_column(df):
    model = NetworkFeatureGenerator(featureCols=["wet"], iterations=4).fit(df)
    assert {r["wet"]: r["lambda_wet"] for r in model.transform(df).collect()} == pytest.approx({v: bdeu("wet", [])[(v,)] for v in set(WET)})


def test_cycle_and_unknown_column_are_rejected(df):
    for edges in ([("wet", "rain"), ("rain", "wet")], [("rain", "snow")]):
        with pytest.raises(ValueError):
            NetworkFeatureGenerator(featureCols=NODES, knownStructure=edges).fit(df)


def test_save_and_load(spark, df, model, tmp_path):
    model.save(str(tmp_path / "net"))
    again = NetworkFeatureModel.load(spark, str(tmp_path / "net"))
    assert again.edges == CHAIN and again.num_classes == 2
    assert sorted(again.transform(df).collect()) == sorted(model.transform(df).collect())


def test_scoring_broadcasts_and_stays_in_the_jvm(df, model):
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("cells", [10**6, 1])
def test_stream_scores_like_a_batch(spark, df, model, tmp_path, cells):
    model = NetworkFeatureModel(fit_network(df, NODES, CHAIN, max_cells=cells), 2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = score_stream(model, stream, out, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert sorted(spark.read.parquet(out).collect()) == sorted(model.transform(df).collect())
    with pytest.raises(ValueError):
        score_stream(model, df, out, str(tmp_path / "c2"))


def test_samples_hold_their_share_of_every_combination(spark):
    from evidentia.operators.structure import FIRST_FRACTION, STAGES, staged

    rows = [(a, b) for a in range(4) for b in range(5) for _ in range(1 + 37 * a * b)]
    wanted = {(a, b): rows.count((a, b)) for a, b in set(rows)}
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "a int, b int").repartition(parts)
        found.append(sorted(staged(compress(df, ["a", "b"]), ["a", "b"], 3).collect()))
    assert found[0] == found[1]
    for s in range(STAGES):
        share = FIRST_FRACTION * 2 ** (s + 1) if s < STAGES - 1 else 1.0
        sizes = {cell: sum(r["n"] for r in found[0] if (r["a"], r["b"]) == cell and r["entered"] <= s) for cell in wanted}
        assert all(abs(sizes[cell] - share * n) <= 1 for cell, n in wanted.items())


def test_columns_of_many_values_can_be_linked(spark):
    df = spark.range(8000).select((F.col("id") % 2000).cast("int").alias("p"), (F.col("id") % 2000 % 1500).cast("int").alias("c"))
    assert learn_structure(df, ["p", "c"], iterations=0).edges == [("p", "c")]


def moral_separation(edges, x, y, z):
    """d-separation by the moral graph of the ancestors."""
    above = descendants([(b, a) for a, b in edges], {x, y, *z})
    kept = [(a, b) for a, b in edges if a in above and b in above]
    links = {frozenset(e) for e in kept} | {frozenset((a, c)) for a, b in kept for c, d in kept if b == d and a != c}
    seen, todo = set(), [x]
    while todo:
        c = todo.pop()
        if c not in seen and c not in z:
            seen.add(c)
            todo += [o for e in links if c in e for o in e if o != c]
    return y not in seen


def test_reachability_equals_moral_separation():
    import random

    rng = random.Random(2)
    for _ in range(150):
        nodes = list("abcdef")
        edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.4]
        x, y = rng.sample(nodes, 2)
        z = [c for c in nodes if c not in (x, y) and rng.random() < 0.4]
        assert (y not in connected(edges, [x], z)) == moral_separation(edges, x, y, z)


def test_backdoor_sets(spark):
    collider = [("u", "x"), ("u", "m"), ("v", "m"), ("v", "y"), ("x", "y")]
    assert backdoor_set(collider, ["x"], "y") == []  # the parents of x are u: not needed, as m is a collider
    both = [*collider, ("m", "x"), ("m", "y")]
    assert backdoor_set(both, ["x"], "y") == ["m", "u"]  # m opens the way from u to v
    assert backdoor_set(both, ["x"], "y", unusable=["u"]) == ["m", "v"]
    assert backdoor_set(both, ["x"], "y", unusable=["u", "v"]) is None
    assert backdoor_set([("x", "c"), ("y", "c"), ("x", "w"), ("w", "y")], ["x"], "y") == []  # nothing below x
    edges = spark.createDataFrame([*both, *both], "parent string, child string")
    assert [r.feature for r in adjustment_columns(edges, ["x"], "y").collect()] == ["m", "u"]
    assert [r.feature for r in adjustment_columns(edges, ["x"]).orderBy("feature").collect()] == ["m", "u"]
    with pytest.raises(ValueError, match="separate"):
        adjustment_columns(edges, ["x"], "y", ["m"])
    with pytest.raises(ValueError, match="treatment"):
        backdoor_set(both, ["x"], "x")


def test_backdoor_sets_are_minimal_and_found_whenever_there_is_one():
    import random

    rng = random.Random(7)
    for _ in range(60):
        nodes = list("abcdefg")
        edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if rng.random() < 0.35]
        x, y = sorted(rng.sample(nodes, 2))
        hidden = [c for c in nodes if c not in (x, y) and rng.random() < 0.3]
        rest = [e for e in edges if e[0] != x]
        usable = [c for c in nodes if c not in descendants(edges, [x]) and c != y and c not in hidden]
        good = [set(z) for k in range(len(usable) + 1) for z in combinations(usable, k) if moral_separation(rest, x, y, list(z))]
        found = backdoor_set(edges, [x], y, hidden)
        assert (found is None) == (not good)
        if found is not None:
            assert set(found) in good and not any(set(found) - {c} in good for c in found)


def test_lookups_of_large_tables_count_the_rows_as_they_came(spark, monkeypatch):
    from evidentia.operators import inference

    df = spark.createDataFrame([(i % 2, i % 5, i % 3) for i in range(60)], "a int, b int, c int")
    network = fit_network(df, ["a", "b", "c"], [("a", "b"), ("a", "c"), ("b", "c")], max_cells=1)
    seen = []
    monkeypatch.setattr(inference, "key_counts", lambda rows, keys, count=inference.key_counts: seen.append((rows.columns, keys)) or count(rows, keys))
    with_probabilities(df.drop("b"), network)
    assert seen and all(columns == ["a", "c"] for columns, _ in seen) and len({k for _, k in seen}) == len(seen)
