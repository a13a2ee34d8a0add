"""Queries on causal effects, model explanation and unit importance."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.sampling import hash_split
from evidentia.operators.ace import AverageCausalEffect
from evidentia.operators.ace import adjustment_columns as adjustment
from evidentia.operators.bn_features import NetworkFeatureGenerator
from evidentia.operators.causal_selector import CausalFeatureSelector
from evidentia.operators.layers import UnitImportance, response_norms
from evidentia.operators.models import accuracy, forest, with_confidence
from evidentia.plans.common import r6, registry, sql_r6, sql_uniform, table
from evidentia.plans.networks import EDGES, NODES, PARENTS, _screened_sql, screened, sql_lambda
from evidentia.plans.selection import FEATURES, TARGET
from evidentia.session import cut_lineage

REG = registry()
OUTCOME = "l_extendedprice"


@REG.add(
    "adjustment_columns",
    f"WITH {_screened_sql()} SELECT DISTINCT parent AS feature FROM edges WHERE child = 'net' AND parent <> 'net'",
)
def adjustment_columns(spark, sf_dir) -> DataFrame:
    return adjustment(screened(spark, sf_dir), ["net"])


# On top of the edges that the data show: two further causes of the prices, of which one way between them leads through a collider.
CAUSES = [("season", "flag"), ("season", "dear"), ("flag", "status"), ("habit", "flag"), ("habit", "net"), ("habit", "dear")]


def _backdoor_sql(x: str, y: str) -> str:
    """All backdoor paths, what blocks them, all sets of usable columns, and the walk from the largest set downwards."""
    listed = " UNION ".join(f"SELECT '{a}', '{b}'" for a, b in CAUSES)
    return (
        f"WITH RECURSIVE {_screened_sql()}, g(parent, child) AS MATERIALIZED (SELECT parent, child FROM edges UNION {listed}), "
        "below(top, c) AS (SELECT DISTINCT parent, parent FROM g UNION SELECT child, child FROM g UNION SELECT top, child FROM below JOIN g ON parent = c), "
        f"usable AS (SELECT c, (row_number() OVER (ORDER BY c) - 1)::INTEGER AS bit FROM (SELECT DISTINCT top AS c FROM below WHERE c IN ('{x}', '{y}') "
        f"AND top NOT IN (SELECT c FROM below WHERE top = '{x}') AND top <> '{y}')), "
        f"steps AS (SELECT parent AS a, child AS b, true AS forth FROM g WHERE parent <> '{x}' UNION ALL SELECT child, parent, false FROM g WHERE parent <> '{x}'), "
        f"paths(tip, forth, nodes, colliders) AS (SELECT b, forth, [b], []::VARCHAR[] FROM steps WHERE a = '{x}' UNION ALL SELECT s.b, s.forth, list_append(nodes, s.b), "
        f"CASE WHEN p.forth AND NOT s.forth THEN list_append(colliders, p.tip) ELSE colliders END FROM paths p JOIN steps s ON s.a = p.tip "
        f"WHERE p.tip <> '{y}' AND NOT list_contains(nodes, s.b) AND s.b <> '{x}'), "
        f"whole AS MATERIALIZED (SELECT row_number() OVER () AS p, nodes, colliders FROM paths WHERE tip = '{y}'), "
        "masks AS (SELECT range AS m FROM range((SELECT (1 << count(*))::BIGINT FROM usable))), "
        f"plain AS (SELECT p, unnest(nodes) AS c, colliders FROM whole), "
        "stops AS (SELECT p, sum(1 << bit)::BIGINT AS plain FROM plain JOIN usable USING (c) WHERE NOT list_contains(colliders, c) GROUP BY p), "
        "opens AS (SELECT p, k, coalesce(sum(1 << bit), 0)::BIGINT AS need FROM (SELECT p, unnest(colliders) AS k FROM whole) JOIN below ON top = k LEFT JOIN usable USING (c) GROUP BY p, k), "
        "good AS MATERIALIZED (SELECT m FROM masks WHERE NOT EXISTS (SELECT 1 FROM whole LEFT JOIN stops USING (p) WHERE m & coalesce(plain, 0) = 0 "
        "AND NOT EXISTS (SELECT 1 FROM opens WHERE opens.p = whole.p AND m & need = 0))), "
        "walk(m, bit) AS (SELECT (SELECT max(m) FROM masks WHERE m IN (SELECT m FROM good)), (SELECT count(*) FROM usable) UNION ALL "
        "SELECT CASE WHEN m & (1 << (bit - 1)) > 0 AND m - (1 << (bit - 1)) IN (SELECT m FROM good) THEN m - (1 << (bit - 1)) ELSE m END, bit - 1 FROM walk WHERE bit > 0) "
        "SELECT c AS feature FROM walk JOIN usable u ON walk.bit = 0 AND walk.m & (1 << u.bit) > 0"
    )


@REG.add("adjustment_backdoor", _backdoor_sql("dear", "net"))
def adjustment_backdoor(spark, sf_dir) -> DataFrame:
    """A minimal set against confounding of dear and net on the edges that the data show and some that are given."""
    given = spark.createDataFrame(CAUSES, "parent string, child string")
    return adjustment(screened(spark, sf_dir).unionByName(given), ["dear"], "net")


@REG.add("ace_single", f"SELECT 'l_quantity' AS treatment, {sql_r6('regr_slope(l_extendedprice, l_quantity)')} AS effect FROM lineitem")
def ace_single(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    model = AverageCausalEffect(treatments=["l_quantity"], outcome=OUTCOME).fit(df)
    return model.table(spark).select("treatment", r6("effect").alias("effect"))


def sql_two(y: str, a: str, b: str) -> tuple[str, str]:
    """Coefficients of y on a and b."""
    det = f"(var_pop({a}) * var_pop({b}) - pow(covar_pop({a}, {b}), 2))"
    first = f"(covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b})) / {det}"
    second = f"(covar_pop({b}, {y}) * var_pop({a}) - covar_pop({a}, {y}) * covar_pop({a}, {b})) / {det}"
    return first, second


_A, _B = sql_two(OUTCOME, "l_quantity", "l_discount")
_TWO = f"SELECT 'l_quantity' AS treatment, {_A} AS effect FROM lineitem UNION ALL SELECT 'l_discount', {_B} FROM lineitem"


@REG.add("ace_two", f"SELECT treatment, {sql_r6('effect')} AS effect FROM ({_TWO})")
def ace_two(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    model = AverageCausalEffect(treatments=["l_quantity", "l_discount"], outcome=OUTCOME).fit(df)
    return model.table(spark).select("treatment", r6("effect").alias("effect"))


@REG.add(
    "ace_direction",
    f"SELECT treatment, CASE WHEN effect < 0 THEN 'reduces' ELSE 'increases' END AS direction FROM ({_TWO})",
)
def ace_direction(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return AverageCausalEffect(treatments=["l_quantity", "l_discount"], outcome=OUTCOME).fit(df).table(spark).select("treatment", "direction")


def _placebo_sql(runs: int) -> str:
    parts = []
    for r in range(runs):
        run, key = f"'run{r}'", "o_orderkey::VARCHAR"
        u = sql_uniform(key, run, 5)
        first, _ = sql_two("o_totalprice", "u", "c")
        parts.append(f"SELECT {r}::INT AS run, {sql_r6(first)} AS effect FROM (SELECT o_totalprice, {u} AS u, o_custkey::DOUBLE AS c FROM orders)")
    return " UNION ALL ".join(parts)


@REG.add("placebo_effect", _placebo_sql(5))
def placebo_effect(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    model = AverageCausalEffect(treatments=["year"], outcome="o_totalprice", adjustment=["o_custkey"]).fit(df)
    return model.placebo(df, ["o_orderkey"], runs=5, seed=5).withColumn("effect", r6("effect"))


MODEL_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
MODEL_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _model_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*MODEL_KEYS, *MODEL_FEATURES, "l_returnflag")


@REG.add("rf_accuracy")
def rf_accuracy(spark, sf_dir) -> DataFrame:
    train, test = hash_split(_model_rows(spark, sf_dir), MODEL_KEYS, 0.7, 42)
    model = forest(MODEL_FEATURES, "l_returnflag").fit(train)
    return accuracy(with_confidence(model, test)).withColumn("accuracy", r6("accuracy"))


@REG.add("explain_one_row")
def explain_one_row(spark, sf_dir) -> DataFrame:
    """The prediction for one row: the first one of the test part."""
    train, test = hash_split(_model_rows(spark, sf_dir), MODEL_KEYS, 0.7, 42)
    model = forest(MODEL_FEATURES, "l_returnflag").fit(train)
    one = cut_lineage(test.orderBy(*MODEL_KEYS).limit(1))
    return with_confidence(model, one).select(*MODEL_KEYS, "l_returnflag", "prediction", r6("confidence").alias("confidence"))


@REG.add("ace_confidence")
def ace_confidence(spark, sf_dir) -> DataFrame:
    df = _model_rows(spark, sf_dir)
    model = forest(MODEL_FEATURES, "l_returnflag").fit(df)
    effects = AverageCausalEffect(treatments=MODEL_FEATURES, outcome="confidence").fit(with_confidence(model, df))
    return effects.table(spark)


def _facts(spark, rows: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "fact string, value double").select("fact", r6("value").alias("value"))


def sql_facts(rows: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS fact, {sql_r6(v)} AS value" for n, v in rows.items())


_TEST = f"(SELECT * FROM lineitem WHERE NOT {sql_uniform(*[f'{c}::VARCHAR' for c in MODEL_KEYS], 42)} < 0.7)"


@REG.add(
    "rf_accuracy_facts",
    sql_facts({
        "test rows": f"(SELECT count(*) FROM {_TEST})", "accuracy less right rows over all": "0", "accuracy outside 0 to 1": "0",
        "classes": "(SELECT count(DISTINCT l_returnflag) FROM lineitem)", "confidence below an even guess": "0", "confidence above 1": "0",
    }),
)
def rf_accuracy_facts(spark, sf_dir) -> DataFrame:
    """What must hold of a forest's accuracy and confidence whatever trees it grew; rows and classes are counted."""
    train, test = hash_split(_model_rows(spark, sf_dir), MODEL_KEYS, 0.7, 42)
    model = forest(MODEL_FEATURES, "l_returnflag").fit(train)
    labels = list(model.stages[0].labels)
    scored = with_confidence(model, test)
    found = accuracy(scored).first()
    index = F.array_position(F.array(*[F.lit(c) for c in labels]), F.col("l_returnflag")) - 1
    again = scored.agg(
        F.count_if(F.col("prediction") == index).alias("right"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 1 / (len(labels) + 1) - 1e-9).alias("low"),
        F.count_if(F.col("confidence") > 1 + 1e-9).alias("high")).first()
    return _facts(spark, [
        ("test rows", found["n"]), ("accuracy less right rows over all", found["accuracy"] - again["right"] / again["n"]),
        ("accuracy outside 0 to 1", float(not 0 <= found["accuracy"] <= 1)), ("classes", len(labels)), ("confidence below an even guess", again["low"]), ("confidence above 1", again["high"]),
    ])


@REG.add(
    "explain_row_facts",
    f"WITH one AS (SELECT * FROM {_TEST} ORDER BY {', '.join(MODEL_KEYS)} LIMIT 1) "
    + sql_facts({**{c: f"(SELECT {c} FROM one)" for c in MODEL_KEYS}, "rows": "1", "the class is a label": "1", "confidence outside even guess to 1": "0"}),
)
def explain_row_facts(spark, sf_dir) -> DataFrame:
    """Which row is explained, and that its prediction is one of the classes with a confidence that can be."""
    rows = explain_one_row(spark, sf_dir).collect()
    classes = _model_rows(spark, sf_dir).select("l_returnflag").distinct().count()
    r = rows[0]
    return _facts(spark, [
        *[(c, r[c]) for c in MODEL_KEYS], ("rows", len(rows)), ("the class is a label", r["prediction"] in range(classes)),
        ("confidence outside even guess to 1", not 1 / (classes + 1) <= r["confidence"] <= 1),
    ])


@REG.add(
    "ace_confidence_facts",
    sql_facts({"treatments": str(len(MODEL_FEATURES)), "rows": "(SELECT count(*) FROM lineitem)", **{f"residual along {c}": "0" for c in MODEL_FEATURES}}),
)
def ace_confidence_facts(spark, sf_dir) -> DataFrame:
    """The effects on a model's confidence are those of least squares: what they leave over is orthogonal to every treatment."""
    df = _model_rows(spark, sf_dir)
    scored = cut_lineage(with_confidence(forest(MODEL_FEATURES, "l_returnflag").fit(df), df).select(*MODEL_FEATURES, "confidence"))
    effects = AverageCausalEffect(treatments=MODEL_FEATURES, outcome="confidence").fit(scored).effects
    rest = F.col("confidence")
    for c, effect in effects.items():
        rest = rest - F.lit(effect) * F.col(c)
    along = scored.withColumn("rest", rest).agg(F.count(F.lit(1)).alias("n"), *[F.corr("rest", c).alias(c) for c in MODEL_FEATURES]).first()
    return _facts(spark, [("treatments", len(effects)), ("rows", along["n"]), *[(f"residual along {c}", along[c]) for c in MODEL_FEATURES]])


# Units as slices of the vectors: 4 layers of 2 units with 8 numbers each.
LAYERS, UNITS, WIDTH = 4, 2, 8
LAYER_NAMES = [f"layer{i}" for i in range(LAYERS)]


def activations(spark, sf_dir) -> DataFrame:
    slot = F.explode(F.sequence(F.lit(0), F.lit(LAYERS * UNITS - 1))).alias("slot")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding", slot)
    return rows.select(
        "sample_id",
        F.concat(F.lit("layer"), F.floor(F.col("slot") / UNITS).cast("string")).alias("layer"),
        (F.col("slot") % UNITS).alias("unit"),
        F.slice("embedding", F.col("slot") * WIDTH + 1, F.lit(WIDTH)).alias("response"),
    )


def _norm_sql(layer: int, unit: int) -> str:
    first = (layer * UNITS + unit) * WIDTH
    return "sqrt(" + " + ".join(f"pow(embedding[{first + j + 1}]::DOUBLE, 2)" for j in range(WIDTH)) + ")"


_WIDE = "w AS (SELECT vec_id, " + ", ".join(f"{_norm_sql(i, u)} AS u{i}_{u}" for i in range(LAYERS) for u in range(UNITS)) + " FROM embeddings)"


@REG.add(
    "activation_norms",
    " UNION ALL ".join(
        f"SELECT vec_id AS sample_id, 'layer{i}' AS layer, {u}::INT AS unit, {sql_r6(_norm_sql(i, u))} AS norm FROM embeddings"
        for i in range(LAYERS) for u in range(UNITS)
    ),
)
def activation_norms(spark, sf_dir) -> DataFrame:
    return response_norms(activations(spark, sf_dir)).withColumn("norm", r6("norm"))


def _chain_sql() -> str:
    """``c``: one row with the coefficients ``a<layer>_<unit>``, ``b..`` and intercepts ``k..``."""
    cols = []
    for i in range(1, LAYERS):
        for u in range(UNITS):
            x, z, y = f"u{i - 1}_0", f"u{i - 1}_1", f"u{i}_{u}"
            a, b = sql_two(y, x, z)
            cols.append(f"{a} AS a{i}_{u}, {b} AS b{i}_{u}, avg({y}) - ({a}) * avg({x}) - ({b}) * avg({z}) AS k{i}_{u}")
    return f"{_WIDE}, c AS (SELECT {', '.join(cols)} FROM w)"


@REG.add(
    "scm_fit",
    f"WITH {_chain_sql()} " + " UNION ALL ".join(
        f"SELECT 'layer{i}' AS layer, {u}::INT AS unit, {s}::INT AS source, {sql_r6(f'{n}{i}_{u}')} AS coefficient FROM c"
        for i in range(1, LAYERS) for u in range(UNITS) for s, n in ((0, "a"), (1, "b"), ("NULL", "k"))
    ),
)
def scm_fit(spark, sf_dir) -> DataFrame:
    rows = activations(spark, sf_dir)
    return UnitImportance(layers=LAYER_NAMES).fit(rows).equations(rows).withColumn("coefficient", r6("coefficient"))


def _predicted(layer: int, unit: int) -> str:
    if layer == 0:
        return f"u0_{unit}"
    below = [_predicted(layer - 1, u) for u in range(UNITS)]
    return f"(k{layer}_{unit} + a{layer}_{unit} * {below[0]} + b{layer}_{unit} * {below[1]})"


_ERROR = " + ".join(f"pow({_predicted(LAYERS - 1, u)} - u{LAYERS - 1}_{u}, 2)" for u in range(UNITS))


@REG.add("scm_mse", f"WITH {_chain_sql()} SELECT {sql_r6(f'avg(({_ERROR}) / {UNITS})')} AS mse FROM w CROSS JOIN c")
def scm_mse(spark, sf_dir) -> DataFrame:
    rows = activations(spark, sf_dir)
    return UnitImportance(layers=LAYER_NAMES).fit(rows).mse(rows).select(r6("mse").alias("mse"))


def _propagated(layer: int, unit: int, start: int, values: list[str]) -> str:
    """The prediction of a unit from the given values of layer ``start``."""
    if layer == start:
        return values[unit]
    below = [_propagated(layer - 1, u, start, values) for u in range(UNITS)]
    return f"(k{layer}_{unit} + a{layer}_{unit} * {below[0]} + b{layer}_{unit} * {below[1]})"


def _ablation_sql() -> str:
    parts = []
    for i in range(LAYERS - 1):
        for u in range(UNITS):
            whole = [f"u{i}_{v}" for v in range(UNITS)]
            cut = ["0e0" if v == u else f"u{i}_{v}" for v in range(UNITS)]
            change = " + ".join(
                f"abs({_propagated(LAYERS - 1, v, i, whole)} - {_propagated(LAYERS - 1, v, i, cut)})" for v in range(UNITS)
            )
            parts.append(f"SELECT 'layer{i}' AS layer, {u}::INT AS unit, {sql_r6(f'avg(({change}) / {UNITS})')} AS importance FROM w CROSS JOIN c")
    return " UNION ALL ".join(parts)


@REG.add("scm_ablation", f"WITH {_chain_sql()} {_ablation_sql()}")
def scm_ablation(spark, sf_dir) -> DataFrame:
    rows = activations(spark, sf_dir)
    return UnitImportance(layers=LAYER_NAMES).fit(rows).importance(rows).withColumn("importance", r6("importance"))


@REG.add("scm_top_filters", f"WITH {_chain_sql()} SELECT * FROM ({_ablation_sql()}) ORDER BY importance DESC, layer, unit LIMIT 3")
def scm_top_filters(spark, sf_dir) -> DataFrame:
    rows = activations(spark, sf_dir)
    return UnitImportance(layers=LAYER_NAMES).fit(rows).top(rows, 3).withColumn("importance", r6("importance"))


@REG.add("select_then_score", sql_lambda(PARENTS, ["l_orderkey", "l_linenumber", *FEATURES], "lineitem"))
def select_then_score(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", *NODES, *FEATURES, TARGET)
    stages = Pipeline(stages=[
        CausalFeatureSelector(featureCols=FEATURES, labelCol=TARGET, keepCols=["l_orderkey", *NODES]),
        NetworkFeatureGenerator(featureCols=NODES, knownStructure=EDGES),
    ])
    scored = stages.fit(df).transform(df)
    return scored.select("l_orderkey", "l_linenumber", *FEATURES, *[r6(f"lambda_{c}").alias(f"lambda_{c}") for c in NODES])
