"""Queries on network structure, parameters and features."""

from __future__ import annotations

import random
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.bn_features import NetworkFeatureGenerator
from evidentia.operators.cpt import Network, fit_network
from evidentia.operators.families import cardinalities, compress, edge_gains, named_bic_scores, network_score, screened_edges
from evidentia.operators.graph import allowed_edges, is_acyclic, parent_table
from evidentia.operators.inference import with_probabilities
from evidentia.operators.selection import MarkovBlanketSelector, markov_blanket
from evidentia.operators.structure import learn_structure, random_forest
from evidentia.plans.common import r6, registry, sql_r6, table
from evidentia.session import scratch_path

REG = registry()
NODES = ["l_returnflag", "l_linestatus", "l_linenumber"]
EDGES = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]
PARENTS = {"l_returnflag": [], "l_linestatus": ["l_returnflag"], "l_linenumber": ["l_returnflag", "l_linestatus"]}
KEYS = ["l_orderkey", "l_linenumber"]

# Columns with real dependences, derived from lineitem.
ORDER = ["bulk", "reduced", "dear", "net", "flag", "status"]
DERIVED_SQL = (
    "SELECT (l_quantity >= 25)::INT AS bulk, (l_discount >= 0.05)::INT AS reduced, "
    "(floor(l_extendedprice / 20000))::BIGINT AS dear, floor(l_extendedprice * (1 - l_discount) / 15000)::BIGINT AS net, "
    "l_returnflag AS flag, l_linestatus AS status FROM lineitem"
)


def derived(spark, sf_dir, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *extra,
        (F.col("l_quantity") >= 25).cast("int").alias("bulk"),
        (F.col("l_discount") >= 0.05).cast("int").alias("reduced"),
        F.floor(F.col("l_extendedprice") / 20000).alias("dear"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 15000).alias("net"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def sql_bic(node: str, parents: list[str], source: str = "lineitem") -> str:
    keys = ", ".join([*parents, node])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    q = " * ".join(f"count(DISTINCT {p})" for p in parents) or "1"
    return (
        f"((SELECT sum(n * ln(n / m)) FROM (SELECT n, sum(n) OVER ({part}) AS m FROM (SELECT {keys}, count(*)::DOUBLE AS n "
        f"FROM {source} GROUP BY {keys}))) - (SELECT 0.5e0 * ln(count(*)::DOUBLE) * {q} * (count(DISTINCT {node}) - 1) FROM {source}))"
    )


FAMILIES = [
    (c, tuple(p)) for c in NODES for p in ([], [NODES[0]], [NODES[1]], [NODES[2]], NODES[:2], NODES[1:], [NODES[0], NODES[2]]) if c not in p
]


@REG.add(
    "bic_family_scores",
    " UNION ALL ".join(f"SELECT '{c}' AS node, '{','.join(p)}' AS parents, {sql_r6(sql_bic(c, list(p)))} AS score" for c, p in FAMILIES),
)
def bic_family_scores(spark, sf_dir) -> DataFrame:
    counts = compress(table(spark, sf_dir, "lineitem"), NODES)
    return named_bic_scores(counts, FAMILIES, cardinalities(counts, NODES)).withColumn("score", r6("score"))


@REG.add(
    "network_score",
    f"SELECT {sql_r6(' + '.join(sql_bic(c, p) for c, p in PARENTS.items()) + f' - 0.1e0 * {len(EDGES)}')} AS score",
)
def network_score_query(spark, sf_dir) -> DataFrame:
    counts = compress(table(spark, sf_dir, "lineitem"), NODES)
    families = [(c, tuple(p)) for c, p in PARENTS.items()]
    return network_score(counts, families, cardinalities(counts, NODES)).select(r6("score").alias("score"))


def sql_cpt(node: str, parents: list[str], source: str = "lineitem", ess: str = "5e0") -> str:
    """Typed probability table of one node: parents, node, n, prob."""
    keys = [*parents, node]
    grid = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM {source} WHERE {c} IS NOT NULL)" for c in keys)
    q = " * ".join(f"(SELECT count(DISTINCT {p}) FROM {source})" for p in parents) or "1"
    r = f"(SELECT count(DISTINCT {node}) FROM {source})"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    totals = f"sum(coalesce(n, 0)) OVER ({'PARTITION BY ' + ', '.join(parents) if parents else ''})"
    return (
        f"(SELECT {', '.join(keys)}, coalesce(n, 0)::BIGINT AS n, (coalesce(n, 0) + {ess} / ({r} * {q})) / ({totals} + {ess} / ({q})) AS prob "
        f"FROM {grid} LEFT JOIN (SELECT {', '.join(keys)}, count(*) AS n FROM {source} WHERE {complete} GROUP BY ALL) USING ({', '.join(keys)}))"
    )


def sql_long_cpt(parents: dict[str, list[str]], source: str = "lineitem") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS node, {' || chr(124) || '.join(f'{x}::VARCHAR' for x in p) if p else chr(39) * 2} AS pa, {c}::VARCHAR AS state, n, "
        f"{sql_r6('prob')} AS prob FROM {sql_cpt(c, p, source)}"
        for c, p in parents.items()
    )


def _long(network: Network) -> DataFrame:
    return network.cpt.select("node", F.array_join("pa", "|").alias("pa"), "state", "n", r6("prob").alias("prob"))


@REG.add("bdeu_cpt", sql_long_cpt(PARENTS))
def bdeu_cpt(spark, sf_dir) -> DataFrame:
    return _long(fit_network(table(spark, sf_dir, "lineitem"), NODES, EDGES))


@REG.add(
    "bdeu_cpt_large",
    f"SELECT l_suppkey, count(*) AS cells, sum(n)::BIGINT AS n, {sql_r6('sum(prob)')} AS prob, {sql_r6('max(prob)')} AS most, {sql_r6('min(prob)')} AS least "
    f"FROM {sql_cpt('l_partkey', ['l_suppkey'])} GROUP BY l_suppkey",
)
def bdeu_cpt_large(spark, sf_dir) -> DataFrame:
    """The whole table of a node with more cells than are kept for lookups, added up by parent state."""
    network = fit_network(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], [("l_suppkey", "l_partkey")], max_cells=1000)
    return network.complete_table("l_partkey").groupBy("l_suppkey").agg(
        F.count("*").alias("cells"), F.sum("n").alias("n"), r6(F.sum("prob")).alias("prob"),
        r6(F.max("prob")).alias("most"), r6(F.min("prob")).alias("least"),
    )


@REG.add("cpt_save_load", sql_long_cpt(PARENTS))
def cpt_save_load(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "network")
    fit_network(table(spark, sf_dir, "lineitem"), NODES, EDGES).save(path)
    return _long(Network.load(spark, path))


def sql_lambda(parents: dict[str, list[str]], keys: list[str], rows: str, source: str = "lineitem", fallback: str = "0.5e0") -> str:
    cols = ", ".join(f"{sql_r6(f'coalesce(t_{c}.prob, {fallback})')} AS lambda_{c}" for c in parents)
    joins = " ".join(
        f"LEFT JOIN {sql_cpt(c, p, source)} t_{c} ON " + " AND ".join(f"t_{c}.{k} = d.{k}" for k in [*p, c])
        for c, p in parents.items()
    )
    return f"SELECT {', '.join(f'd.{k}' for k in keys)}, {cols} FROM {rows} d {joins}"


def _lambdas(df: DataFrame, keys: list[str], nodes: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(f"lambda_{c}").alias(f"lambda_{c}") for c in nodes])


@REG.add("bn_lambda", sql_lambda(PARENTS, KEYS, "lineitem"))
def bn_lambda(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", *NODES)
    model = NetworkFeatureGenerator(featureCols=NODES, knownStructure=EDGES).fit(df)
    return _lambdas(model.transform(df), KEYS, NODES)


_ORDER_PARENTS = {"o_orderstatus": [], "o_orderpriority": ["o_orderstatus"]}


@REG.add(
    "bn_lambda_append",
    sql_lambda(_ORDER_PARENTS, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"], "orders", "orders"),
)
def bn_lambda_append(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    model = NetworkFeatureGenerator(featureCols=list(_ORDER_PARENTS), knownStructure=[("o_orderstatus", "o_orderpriority")]).fit(df)
    return _lambdas(model.transform(df), df.columns, list(_ORDER_PARENTS))


_STRANGE_SQL = (
    "(SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS l_returnflag, "
    "CASE WHEN l_linenumber = 1 THEN 'X' ELSE l_linestatus END AS l_linestatus FROM lineitem)"
)


@REG.add("bn_lambda_unseen", sql_lambda(PARENTS, KEYS, _STRANGE_SQL, fallback="1e0 / 3"))
def bn_lambda_unseen(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", *NODES)
    model = NetworkFeatureGenerator(featureCols=NODES, labelCol="l_returnflag", knownStructure=EDGES).fit(df)
    strange = df.withColumns({
        "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
        "l_linestatus": F.when(F.col("l_linenumber") == 1, "X").otherwise(F.col("l_linestatus")),
    })
    return _lambdas(model.transform(strange), KEYS, NODES)


@REG.add(
    "bn_lambda_marginal",
    "SELECT d.l_orderkey, d.l_linenumber, " + sql_r6("f.prob") + " AS lambda_l_returnflag, "
    "0.5e0 AS lambda_l_linestatus, " + sql_r6("m.prob") + f" AS lambda_l_linenumber FROM lineitem d "
    f"LEFT JOIN {sql_cpt('l_returnflag', [])} f USING (l_returnflag) LEFT JOIN (SELECT l_returnflag, l_linenumber, sum(a.prob * b.prob) AS prob "
    f"FROM {sql_cpt('l_linenumber', ['l_returnflag', 'l_linestatus'])} a JOIN {sql_cpt('l_linestatus', ['l_returnflag'])} b "
    "USING (l_returnflag, l_linestatus) GROUP BY ALL) m USING (l_returnflag, l_linenumber)",
)
def bn_lambda_marginal(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", *NODES)
    model = NetworkFeatureGenerator(featureCols=NODES, knownStructure=EDGES).fit(df)
    return _lambdas(model.transform(df.drop("l_linestatus")), KEYS, NODES)


_LARGE_SQL = (
    f"WITH s AS MATERIALIZED (SELECT * FROM {sql_cpt('l_suppkey', ['l_returnflag'])}), a AS MATERIALIZED (SELECT * FROM {sql_cpt('l_linenumber', ['l_returnflag', 'l_suppkey'])}), "
    f"f AS MATERIALIZED (SELECT * FROM {sql_cpt('l_returnflag', [])}), m AS (SELECT l_returnflag, l_linenumber, sum(a.prob * s.prob) AS prob "
    "FROM a JOIN s USING (l_returnflag, l_suppkey) GROUP BY ALL) "
    f"SELECT l_orderkey, l_linenumber, {sql_r6('f.prob')} AS lambda_l_returnflag, 0.5e0 AS lambda_l_suppkey, {sql_r6('m.prob')} AS lambda_l_linenumber "
    "FROM lineitem JOIN f USING (l_returnflag) JOIN m USING (l_returnflag, l_linenumber)"
)


@REG.add("bn_lambda_marginal_large", _LARGE_SQL)
def bn_lambda_marginal_large(spark, sf_dir) -> DataFrame:
    """A parent summed out of tables that are treated as too large to lay out."""
    nodes = ["l_returnflag", "l_suppkey", "l_linenumber"]
    edges = [("l_returnflag", "l_suppkey"), ("l_returnflag", "l_linenumber"), ("l_suppkey", "l_linenumber")]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", *nodes)
    network = fit_network(df, nodes, edges, max_cells=10)
    return _lambdas(with_probabilities(df.drop("l_suppkey"), network), KEYS, nodes)


BLACK_LIST = [("bulk", "status"), ("flag", "bulk"), ("dear", "reduced")]


def _gains_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS parent, '{c}' AS child, {sql_bic(c, [p], 'derived')} - {sql_bic(c, [], 'derived')} AS gain"
        for c in ORDER for p in ORDER if p != c
    )


def _screened_sql() -> str:
    place = "CASE {} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(ORDER)) + " END"
    return (
        f"derived AS ({DERIVED_SQL}), edges AS (SELECT parent, child FROM ({_gains_sql()}) WHERE gain > 0 AND "
        f"{place.format('parent')} < {place.format('child')})"
    )


def screened(spark, sf_dir) -> DataFrame:
    counts = compress(derived(spark, sf_dir), ORDER)
    return screened_edges(edge_gains(counts, ORDER, cardinalities(counts, ORDER)), ORDER)


@REG.add(
    "edge_candidates",
    f"WITH derived AS ({DERIVED_SQL}) SELECT parent, child, {sql_r6('gain')} AS gain FROM ({_gains_sql()}) WHERE "
    + " AND ".join(f"NOT (parent = '{a}' AND child = '{b}')" for a, b in BLACK_LIST),
)
def edge_candidates(spark, sf_dir) -> DataFrame:
    counts = compress(derived(spark, sf_dir), ORDER)
    gains = edge_gains(counts, ORDER, cardinalities(counts, ORDER))
    black = spark.createDataFrame(BLACK_LIST, "parent string, child string")
    return allowed_edges(gains, black).select("parent", "child", r6("gain").alias("gain"))


@REG.add(
    "parents_of",
    f"WITH {_screened_sql()} SELECT child, string_agg(parent, ',' ORDER BY parent) AS parents FROM edges GROUP BY child",
)
def parents_of_query(spark, sf_dir) -> DataFrame:
    return parent_table(screened(spark, sf_dir)).select("child", F.array_join("parents", ",").alias("parents"))


@REG.add(
    "markov_blanket",
    f"WITH {_screened_sql()}, kids AS (SELECT child FROM edges WHERE parent = 'dear') SELECT parent AS feature FROM edges WHERE child = 'dear' "
    "UNION SELECT child FROM kids UNION SELECT parent FROM edges JOIN kids USING (child) WHERE parent <> 'dear'",
)
def markov_blanket_query(spark, sf_dir) -> DataFrame:
    return markov_blanket(screened(spark, sf_dir), "dear")


ALPHA, LEAST_ROWS = 0.01, 5.0


def _tests_sql(target: str, cols: list[str]) -> str:
    """Grow and shrink in SQL: statistics of all sets of columns as bit masks, then the two walks as recursive steps."""
    every = [target, *cols]  # bit 0 is the target
    masks = [[c for i, c in enumerate(every) if m >> i & 1] for m in range(1, 1 << len(every))]
    sums = " UNION ALL ".join(f"SELECT {m} AS mask, sum(n * ln(n)) AS h FROM (SELECT count(*)::DOUBLE AS n FROM derived GROUP BY {', '.join(s)})" for m, s in enumerate(masks, 1))
    cards = ", ".join(f"(SELECT count(DISTINCT {c}) FROM derived) AS r{i}" for i, c in enumerate(every))
    states = " * ".join(f"CASE WHEN s.mask & {1 << i} > 0 THEN r{i} ELSE 1 END" for i in range(1, len(every)))
    own = "CASE x " + " ".join(f"WHEN {i} THEN r{i}" for i in range(1, len(every))) + " END"
    z = NormalDist().inv_cdf(1 - ALPHA)
    names = "CASE x " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cols, 1)) + " END"
    h = lambda mask: f"(SELECT h FROM sums WHERE mask = {mask})"
    return (
        f"WITH RECURSIVE derived AS MATERIALIZED ({DERIVED_SQL}), sums AS MATERIALIZED (SELECT 0 AS mask, count(*) * ln(count(*)) AS h FROM derived UNION ALL {sums}), "
        f"cards AS (SELECT count(*) AS n, {cards} FROM derived), "
        f"asked AS (SELECT s.mask, x, n, {states} AS q, {own} AS r, r0 FROM sums s CROSS JOIN range(1, {len(every)}) t(x) CROSS JOIN cards "
        "WHERE s.mask & 1 = 0 AND s.mask & (1 << x)::BIGINT = 0), "
        f"tests AS MATERIALIZED (SELECT mask, x, n >= {LEAST_ROWS} * r * r0 * q AS enough, 2 * ({h('asked.mask | (1 << x) | 1')} - {h('asked.mask | (1 << x)')} - {h('asked.mask | 1')} + "
        f"{h('asked.mask')}) / (f * pow(1 - 2e0 / (9 * f) + {z!r} * sqrt(2e0 / (9 * f)), 3)) AS ratio FROM (SELECT *, greatest(1, (r - 1) * (r0 - 1) * q) AS f FROM asked) asked), "
        "adds AS MATERIALIZED (SELECT mask, arg_max(x, (ratio, -x)) AS x FROM tests WHERE enough AND ratio > 1 GROUP BY mask), "
        f"drops AS MATERIALIZED (SELECT mask | (1 << x) AS mask, arg_min(x, (ratio, x)) AS x FROM tests WHERE enough AND ratio <= 1 GROUP BY mask | (1 << x)), "
        "grown AS (SELECT 0::BIGINT AS mask UNION SELECT grown.mask | (1 << x) FROM grown JOIN adds ON adds.mask = grown.mask), "
        "shrunk AS (SELECT max(mask) AS mask, 0 AS step FROM grown UNION ALL SELECT shrunk.mask - (1 << x), step + 1 FROM shrunk JOIN drops ON drops.mask = shrunk.mask), "
        "blanket AS (SELECT arg_max(mask, step) AS mask FROM shrunk) "
        f"SELECT {names} AS feature, (x - 1)::INTEGER AS position, {sql_r6('ratio')} AS score, blanket.mask & (1 << x)::BIGINT > 0 AS selected FROM blanket "
        "JOIN tests ON tests.mask = blanket.mask & ~((1 << x)::BIGINT)"
    )


@REG.add("markov_blanket_tests", _tests_sql("dear", [c for c in ORDER if c != "dear"]))
def markov_blanket_tests(spark, sf_dir) -> DataFrame:
    """The selector by conditional tests: which columns it keeps, and every column's statistic given the blanket over its limit."""
    model = MarkovBlanketSelector(labelCol="dear", alpha=ALPHA).fit(derived(spark, sf_dir))
    return model.support(spark).withColumn("score", r6("score"))


def _scored_edges(spark, df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """Edges with the score of the child's family."""
    counts = compress(df, ORDER)
    families = [(c, tuple(p for p, k in edges if k == c)) for c in ORDER]
    scores = named_bic_scores(counts, families, cardinalities(counts, ORDER)).where(F.col("parents") != "")
    parent = F.explode(F.split("parents", ",")).alias("parent")
    return scores.select(parent, F.col("node").alias("child"), r6("score").alias("family_score"))


START = random_forest(ORDER, set(BLACK_LIST), random.Random(7))  # the seed alone decides the edges


@REG.add("bn_structure")
def bn_structure(spark, sf_dir) -> DataFrame:
    df = derived(spark, sf_dir, "l_orderkey", "l_linenumber")
    found = learn_structure(df, ORDER, seed=7, black_list=BLACK_LIST)
    return _scored_edges(spark, df, found.edges)


@REG.add(
    "bn_structure_facts",
    f"WITH derived AS ({DERIVED_SQL}) SELECT 'cyclic edges' AS fact, 0e0 AS value UNION ALL SELECT 'forbidden edges', 0e0 "
    "UNION ALL SELECT 'score less the sum of its families', 0e0 UNION ALL SELECT 'not below its forest', 1e0 "
    "UNION ALL SELECT 'score of the forest', "
    + sql_r6(" + ".join(sql_bic(c, [p for p, k in START if k == c], "derived") for c in ORDER) + f" - 0.1e0 * {len(START)}"),
)
def bn_structure_facts(spark, sf_dir) -> DataFrame:
    """What must hold of a learned network whatever the walk found, and the score of the forest that it starts from."""
    df = derived(spark, sf_dir, "l_orderkey", "l_linenumber")
    found = learn_structure(df, ORDER, seed=7, black_list=BLACK_LIST)
    counts = compress(df, ORDER)
    cards = cardinalities(counts, ORDER)

    def score(edges: list[tuple[str, str]]) -> float:
        return network_score(counts, [(c, tuple(p for p, k in edges if k == c)) for c in ORDER], cards).first()["score"]

    again = score(found.edges)
    facts = [
        ("cyclic edges", 0.0 if is_acyclic(ORDER, found.edges) else float(len(found.edges))),
        ("forbidden edges", float(len(set(found.edges) & set(BLACK_LIST)))),
        ("score less the sum of its families", round((found.score - again) / abs(again), 8) + 0.0),
        ("not below its forest", float(found.score >= found.forest_score)),
        ("score of the forest", score(found.forest)),
    ]
    return spark.createDataFrame(facts, "fact string, value double").select("fact", r6("value").alias("value"))


FOREST = random_forest(ORDER, set(), random.Random(7))  # the seed alone decides the edges


@REG.add(
    "bn_forest",
    f"WITH derived AS ({DERIVED_SQL}) " + " UNION ALL ".join(
        f"SELECT '{p}' AS parent, '{c}' AS child, {sql_r6(sql_bic(c, [p], 'derived'))} AS family_score" for p, c in FOREST
    ),
)
def bn_forest(spark, sf_dir) -> DataFrame:
    df = derived(spark, sf_dir, "l_orderkey", "l_linenumber")
    return _scored_edges(spark, df, learn_structure(df, ORDER, iterations=0, seed=7).edges)
