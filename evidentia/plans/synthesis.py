"""Queries on synthetic rows and class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.balance import ClassBalancer
from evidentia.operators.balance import class_imbalance as imbalance
from evidentia.operators.mixture import choose_mixtures, fit_mixtures, gaussian_table
from evidentia.operators.models import rank_consistency
from evidentia.operators.synth import SyntheticGenerator
from evidentia.plans.common import r6, registry, sql_r6, sql_uniform, table
from evidentia.plans.networks import EDGES, NODES, PARENTS, sql_cpt
from evidentia.sources.tables import attach_target

REG = registry()
SEED = 11
PRICE_PARENTS = ["l_returnflag", "l_linestatus"]


@REG.add(
    "gaussian_cpt",
    f"SELECT l_returnflag, l_linestatus, count(*) AS n, {sql_r6('avg(l_extendedprice)')} AS mean, "
    f"{sql_r6('stddev_pop(l_extendedprice)')} AS sd FROM lineitem GROUP BY ALL",
)
def gaussian_cpt(spark, sf_dir) -> DataFrame:
    fitted = gaussian_table(table(spark, sf_dir, "lineitem"), "l_extendedprice", PRICE_PARENTS)
    return fitted.select(*PRICE_PARENTS, "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


def sql_draw(node: str, parents: list[str], source: str, before: str, seed: int) -> str:
    """One sampled column: the state whose probability interval holds the row's uniform number."""
    part = f"PARTITION BY {', '.join(parents)} " if parents else ""
    keys = "".join(f"c.{p} = b.{p} AND " for p in parents)
    u = sql_uniform("b.id::VARCHAR", f"'{node}'", seed)
    cdf = (
        f"(SELECT *, coalesce(lag(hi) OVER ({part}ORDER BY {node}), 0) AS lo, "
        f"{node} = last_value({node}) OVER ({part}ORDER BY {node} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top "
        f"FROM (SELECT *, sum(prob) OVER ({part}ORDER BY {node}) AS hi FROM {sql_cpt(node, parents, source)}))"
    )
    return f"(SELECT b.*, c.{node} FROM {before} b JOIN {cdf} c ON {keys}{u} >= c.lo AND ({u} < c.hi OR c.top))"


def sql_normal(node: str, seed: int) -> str:
    u1, u2 = (sql_uniform("id::VARCHAR", f"'{node}#{i}'", seed) for i in (1, 2))
    return f"sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2})"


def _synthetic_sql() -> str:
    steps, before = ["s AS (SELECT range AS id FROM range((SELECT count(*) FROM lineitem)))"], "s"
    for i, c in enumerate(NODES):
        steps.append(f"s{i} AS {sql_draw(c, PARENTS[c], 'lineitem', before, SEED)}")
        before = f"s{i}"
    return (
        f"WITH {', '.join(steps)}, g AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd "
        f"FROM lineitem GROUP BY ALL) SELECT id, l_returnflag, l_linestatus, l_linenumber, "
        f"round(mean + sd * {sql_normal('l_extendedprice', SEED)}, 3) AS l_extendedprice FROM {before} JOIN g USING (l_returnflag, l_linestatus)"
    )


def generator(components: int = 1) -> SyntheticGenerator:
    return SyntheticGenerator(
        featureCols=NODES, knownStructure=EDGES, numericParents={"l_extendedprice": PRICE_PARENTS}, components=components
    )


@REG.add("synthetic_sample", _synthetic_sql())
def synthetic_sample(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*NODES, "l_extendedprice")
    made = generator().fit(df).sample(df.count(), SEED)
    return made.withColumn("l_extendedprice", F.round("l_extendedprice", 3))


_SPARSE_PARENTS = {"l_suppkey": ["l_returnflag"], "l_partkey": ["l_suppkey"]}


def _sparse_sql() -> str:
    first = sql_draw("l_returnflag", [], "lineitem", "s", SEED)
    steps = ["s AS (SELECT range AS id FROM range((SELECT count(*) FROM lineitem)))", f"s0 AS {first}"]
    for i, (c, parents) in enumerate(_SPARSE_PARENTS.items()):
        steps.append(f"s{i + 1} AS {sql_draw(c, parents, 'lineitem', f's{i}', SEED)}")
    return f"WITH {', '.join(steps)} SELECT id, l_returnflag, l_suppkey, l_partkey FROM s2"


@REG.add("synthetic_sample_large", _sparse_sql())
def synthetic_sample_large(spark, sf_dir) -> DataFrame:
    """Sampling from tables that are treated as too large to lay out: all but the observed cells follow from the prior."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey")
    edges = [(p, c) for c, parents in _SPARSE_PARENTS.items() for p in parents]
    model = SyntheticGenerator(featureCols=df.columns, knownStructure=edges, maxCells=10).fit(df)
    return model.sample(df.count(), SEED)


_LABELLED = "(SELECT toxic, lang, source FROM documents JOIN labels USING (doc_id))"
_LABEL_PARENTS = {"lang": ["toxic"], "source": ["toxic", "lang"]}


def labelled(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return attach_target(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", how="inner")


def _balanced_sql() -> str:
    counts = "(SELECT toxic, count(*) AS n FROM l GROUP BY toxic)"
    deficits = f"(SELECT toxic, (SELECT max(n) FROM {counts}) - n AS missing FROM {counts})"
    return (
        f"WITH l AS {_LABELLED}, d AS (SELECT toxic, sum(missing) OVER (ORDER BY toxic) AS hi, sum(missing) OVER (ORDER BY toxic) - missing AS lo "
        f"FROM {deficits}), s AS (SELECT range AS id, toxic FROM range((SELECT max(hi) FROM d)::BIGINT) JOIN d ON range >= lo AND range < hi), "
        f"s0 AS {sql_draw('lang', ['toxic'], 'l', 's', SEED)}, s1 AS {sql_draw('source', ['toxic', 'lang'], 'l', 's0', SEED)}, "
        "balanced AS (SELECT toxic, lang, source, false AS synthetic FROM l UNION ALL SELECT toxic, lang, source, true FROM s1) "
    )


def _balanced(spark, sf_dir) -> DataFrame:
    df = labelled(spark, sf_dir).select("toxic", "lang", "source")
    edges = [(p, c) for c, parents in _LABEL_PARENTS.items() for p in parents]
    return ClassBalancer(featureCols=["lang", "source"], labelCol="toxic", knownStructure=edges, seed=SEED).fit_resample(df)


@REG.add("oversample_rows", _balanced_sql() + "SELECT * FROM balanced")
def oversample_rows(spark, sf_dir) -> DataFrame:
    return _balanced(spark, sf_dir)


@REG.add("oversample_counts", _balanced_sql() + "SELECT toxic, synthetic, count(*) AS n FROM balanced GROUP BY ALL")
def oversample_counts(spark, sf_dir) -> DataFrame:
    return _balanced(spark, sf_dir).groupBy("toxic", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "class_imbalance",
    f"SELECT toxic AS class, count(*) AS n, {sql_r6('count(*)::DOUBLE / max(count(*)) OVER ()')} AS ratio, "
    "count(*) < 0.5 * max(count(*)) OVER () AS minority FROM labels JOIN documents USING (doc_id) GROUP BY toxic",
)
def class_imbalance(spark, sf_dir) -> DataFrame:
    return imbalance(labelled(spark, sf_dir), "toxic").withColumn("ratio", r6("ratio"))


def _mixture_steps(iterations: int, k: int) -> tuple[list[str], str]:
    """Named steps of ``k`` components per status, the iterations unrolled, and the name of the last parameters; ``<name>_l`` has their likelihood."""
    every, tag = range(k), f"k{k}_"
    starts = ", ".join(f"{1 / k!r}::DOUBLE AS w{c}, (SELECT quantile_cont(l_extendedprice, {(c + 0.5) / k!r}) FROM lineitem) AS m{c}, (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS s{c}" for c in every)
    steps = [f"{tag}p0 AS (SELECT l_linestatus, {starts}, 0::BIGINT AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem))"]

    def expected(i: int) -> str:
        logs = ", ".join(f"ln(w{c}) - ln(s{c}) - pow((l_extendedprice - m{c}) / s{c}, 2) / 2 AS l{c}" for c in every)
        shares = ", ".join(f"1 / ({' + '.join(f'exp(l{o} - l{c})' for o in every)}) AS r{c}" for c in every)
        peak = f"greatest({', '.join(f'l{c}' for c in every)})"
        return (
            f"SELECT *, {shares}, {peak} + ln({' + '.join(f'exp(l{c} - {peak})' for c in every)}) - ln(2 * pi()) / 2 AS density FROM "
            f"(SELECT p.l_linestatus, l_extendedprice AS x, {', '.join(f'm{c}' for c in every)}, {logs} FROM lineitem JOIN {tag}p{i} p USING (l_linestatus))"
        )

    for i in range(iterations):
        part = ", ".join(f"sum(r{c}) / count(*) AS w{c}, any_value(m{c}) + sum(r{c} * (x - m{c})) / sum(r{c}) AS m{c}" for c in every)
        spread = ", ".join(f"sqrt(sum(r{c} * (x - m{c}) * (x - m{c})) / sum(r{c}) - pow(sum(r{c} * (x - m{c})) / sum(r{c}), 2)) AS s{c}" for c in every)
        steps.append(f"{tag}e{i} AS ({expected(i)})")
        steps.append(f"{tag}p{i + 1} AS MATERIALIZED (SELECT l_linestatus, {part}, {spread}, count(*) AS n FROM {tag}e{i} GROUP BY l_linestatus)")
    last = f"{tag}p{iterations}"
    steps.append(f"{last}_l AS (SELECT l_linestatus, sum(density) AS likelihood FROM ({expected(iterations)}) GROUP BY l_linestatus)")
    return steps, last


def _mixture_sql(iterations: int) -> str:
    """Two components per status."""
    steps, last = _mixture_steps(iterations, 2)
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(
        f"SELECT l_linestatus, {c} AS component, n, round(w{c}, 5) + 0e0 AS weight, round(m{c}, 2) + 0e0 AS mean, round(s{c}, 2) + 0e0 AS sd FROM {last}"
        for c in (0, 1)
    )


def _chosen_sql(iterations: int, most: int) -> str:
    steps, rows = [], []
    for k in range(1, most + 1):
        own, last = _mixture_steps(iterations, k)
        steps += own
        rows.append(f"SELECT l_linestatus, n, {k} AS components, -2 * likelihood + {3.0 * k - 1} * ln(n) AS bic, m0 AS first FROM {last} JOIN {last}_l USING (l_linestatus)")
    return (
        f"WITH {', '.join(steps)}, every AS ({' UNION ALL '.join(rows)}) SELECT l_linestatus, any_value(n) AS n, arg_min(components, (bic, components)) AS components, "
        "round(min(bic), 2) + 0e0 AS bic, round(arg_min(first, (bic, components)), 2) + 0e0 AS first_mean FROM every GROUP BY l_linestatus"
    )


@REG.add("gmm_chosen", _chosen_sql(4, 3))
def gmm_chosen(spark, sf_dir) -> DataFrame:
    """How many components the BIC of every status asks for."""
    fitted = choose_mixtures(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linestatus"], most=3, iterations=4)
    return fitted.select("l_linestatus", "n", "components", (F.round("bic", 2) + F.lit(0.0)).alias("bic"), (F.round(F.col("means")[0], 2) + F.lit(0.0)).alias("first_mean"))


@REG.add("gmm_nodes", _mixture_sql(5))
def gmm_nodes(spark, sf_dir) -> DataFrame:
    fitted = fit_mixtures(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_linestatus"], components=2, iterations=5)
    each = F.posexplode(F.arrays_zip("weights", "means", "sds")).alias("component", "p")
    return fitted.select("l_linestatus", "n", each).select(
        "l_linestatus", "component", "n",
        *[(F.round(F.col(f"p.{a}"), d) + F.lit(0.0)).alias(b) for a, b, d in (("weights", "weight", 5), ("means", "mean", 2), ("sds", "sd", 2))],
    )


@REG.add("error_rank_consistency")
def error_rank_consistency(spark, sf_dir) -> DataFrame:
    """Do models rank alike by error on real and on synthetic test rows?"""
    df = labelled(spark, sf_dir)
    model = SyntheticGenerator(
        featureCols=["toxic", "lang", "source"], knownStructure=[("toxic", "lang"), ("toxic", "source")], numericParents={"n_chars": ["toxic"]},
        components=2,
    ).fit(df)
    made = model.sample(df.count(), SEED)
    return rank_consistency(df, made, ["lang", "source"], ["n_chars"], "toxic", key=["doc_id"], seed=SEED)


@REG.add(
    "error_rank_facts",
    "SELECT 'models' AS fact, 5e0 AS value UNION ALL SELECT 'errors outside 0 to 1', 0e0 UNION ALL SELECT 'ranks that are not the errors', 0e0 "
    "UNION ALL SELECT 'correlation less that of the ranks', 0e0",
)
def error_rank_facts(spark, sf_dir) -> DataFrame:
    """Ranks and rank correlation recomputed from the errors."""
    rows = error_rank_consistency(spark, sf_dir).collect()
    wrong, pairs = 0, []
    for r in rows:
        own = [1 + sum(o[f"error_{k}"] < r[f"error_{k}"] for o in rows) for k in ("real", "synthetic")]
        wrong += own != [r["rank_real"], r["rank_synthetic"]]
        pairs.append(own)
    means = [sum(p[i] for p in pairs) / len(pairs) for i in (0, 1)]
    cross = [[sum((p[i] - means[i]) * (p[j] - means[j]) for p in pairs) for j in (0, 1)] for i in (0, 1)]
    expected = cross[0][1] / (cross[0][0] * cross[1][1]) ** 0.5 if cross[0][0] and cross[1][1] else None
    apart = 0.0 if rows[0]["spearman"] is None and expected is None else rows[0]["spearman"] - expected
    facts = [
        ("models", float(len(rows))), ("errors outside 0 to 1", float(sum(not 0 <= r[c] <= 1 for r in rows for c in ("error_real", "error_synthetic")))),
        ("ranks that are not the errors", float(wrong)), ("correlation less that of the ranks", apart),
    ]
    return spark.createDataFrame(facts, "fact string, value double").select("fact", r6("value").alias("value"))
