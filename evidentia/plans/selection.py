"""Queries on the selectors and their projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.causal_selector import CausalFeatureSelector, binned_cells, greedy_effects
from evidentia.operators.entropy import causal_effects, nmi
from evidentia.operators.nmi_selector import NMIFeatureSelector, dominance, relevance
from evidentia.operators.selection import FirstKSelector
from evidentia.plans.common import r6, registry, sql_iqr_codes, sql_r6, table
from evidentia.plans.networks import derived
from evidentia.plans.statistics import NMI_CODES_SQL, NMI_FEATURES, NMI_TARGET, sql_nmi

REG = registry()
FEATURES = ["l_quantity", "l_discount", "l_tax"]
TARGET = "l_extendedprice"


def sql_effect(o: list[str], x: str, y: str, source: str) -> str:
    """Subquery with one row ``(effect, dependent)``."""
    key = "[" + ", ".join(o) + "]::BIGINT[]"
    return (
        "(SELECT sum(n * log2(n * n_o::DOUBLE / (n_ox::DOUBLE * n_oy))) / sum(n) AS effect, "
        "bool_or(n::HUGEINT * n_o::HUGEINT <> n_ox::HUGEINT * n_oy::HUGEINT) AS dependent FROM (SELECT n, "
        "sum(n) OVER (PARTITION BY o) AS n_o, sum(n) OVER (PARTITION BY o, x) AS n_ox, sum(n) OVER (PARTITION BY o, y) AS n_oy "
        f"FROM (SELECT {key} AS o, {x} AS x, {y} AS y, count(*) AS n FROM {source} GROUP BY ALL)))"
    )


def sql_greedy(features: list[str], target: str, codes: str) -> str:
    """The greedy walk unrolled: each step sees the features the steps before it kept."""
    ctes = [f"codes AS ({codes})"]
    for i, c in enumerate(features):
        o = [f"CASE WHEN s{j}.dependent THEN {features[j]} ELSE -1 END" for j in range(i)]
        source = " CROSS JOIN ".join(["codes", *[f"s{j}" for j in range(i)]])
        ctes.append(f"s{i} AS (SELECT * FROM {sql_effect(o, c, target, source)})")
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i}::BIGINT AS position, {sql_r6('effect')} AS effect, dependent AS selected FROM s{i}"
        for i, c in enumerate(features)
    )
    return f"WITH {', '.join(ctes)} {rows}"


_CODES = sql_iqr_codes("lineitem", [*FEATURES, TARGET])


@REG.add("causal_select", sql_greedy(FEATURES, TARGET, _CODES))
def causal_select(spark, sf_dir) -> DataFrame:
    cells = binned_cells(table(spark, sf_dir, "lineitem"), FEATURES, TARGET).persist()
    walked = greedy_effects(cells, FEATURES, TARGET)
    cells.unpersist()
    rows = [(e.feature, e.position, e.effect, e.selected) for e in walked]
    out = spark.createDataFrame(rows, "feature string, position bigint, effect double, selected boolean")
    return out.withColumn("effect", r6("effect"))


_STEPS = [("l_quantity", []), ("l_discount", ["l_quantity"]), ("l_quantity", ["l_discount", "l_tax"])]


@REG.add(
    "causal_effect",
    f"WITH codes AS ({_CODES}) " + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, '{','.join(o)}' AS controls, {sql_r6('effect')} AS effect, dependent FROM {sql_effect(o, x, TARGET, 'codes')}"
        for x, o in _STEPS
    ),
)
def causal_effect(spark, sf_dir) -> DataFrame:
    cells = binned_cells(table(spark, sf_dir, "lineitem"), FEATURES, TARGET)
    at = F.col("step") + 1
    return causal_effects(cells, TARGET, _STEPS).select(
        F.element_at(F.array(*[F.lit(x) for x, _ in _STEPS]), at).alias("feature"),
        F.element_at(F.array(*[F.lit(",".join(o)) for _, o in _STEPS]), at).alias("controls"),
        r6("effect").alias("effect"), "dependent",
    )


@REG.add("causal_select_transform", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def causal_select_transform(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    model = CausalFeatureSelector(featureCols=FEATURES, labelCol=TARGET, keepCols=["l_orderkey", "l_linenumber"]).fit(df)
    return model.transform(df)


@REG.add(
    "nmi_relevance",
    f"WITH codes AS ({NMI_CODES_SQL}) SELECT col_a AS feature, {sql_r6('nmi')} AS nmi, nmi > 0.1 AS relevant "
    f"FROM ({sql_nmi([(c, NMI_TARGET) for c in NMI_FEATURES], 'counts')})",
)
def nmi_relevance(spark, sf_dir) -> DataFrame:
    scores = relevance(table(spark, sf_dir, "lineitem"), NMI_FEATURES, NMI_TARGET, "counts")
    return scores.select("feature", r6("nmi").alias("nmi"), (F.col("nmi") > 0.1).alias("relevant"))


_PAIRS = [(a, b) for a in NMI_FEATURES for b in NMI_FEATURES if a != b]


def _dominant_sql(threshold: float, mode: str) -> str:
    """Features kept after both stages; stage 2 falls away when stage 1 keeps exactly one."""
    return (
        f"WITH codes AS ({NMI_CODES_SQL}), t AS ({sql_nmi([(c, NMI_TARGET) for c in NMI_FEATURES], mode)}), "
        f"p AS ({sql_nmi(_PAIRS, mode)}), kept AS (SELECT col_a AS feature, nmi FROM t WHERE nmi > {threshold} + 1e-12), "
        "dominant AS (SELECT DISTINCT a.feature FROM kept a JOIN p ON p.col_a = a.feature JOIN t b ON b.col_a = p.col_b "
        "WHERE a.nmi > b.nmi + 1e-12 AND p.nmi > b.nmi + 1e-12) "
    )


@REG.add("nmi_dominance", _dominant_sql(0.1, "counts") + f"SELECT feature, {sql_r6('nmi')} AS nmi FROM kept SEMI JOIN dominant USING (feature)")
def nmi_dominance(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    scores = relevance(df, NMI_FEATURES, NMI_TARGET, "counts")
    return dominance(scores, nmi(df, _PAIRS, "counts"), 0.1).select("feature", r6("nmi").alias("nmi"))


@REG.add(
    "nmi_select",
    _dominant_sql(0.00001, "standard")
    + f"SELECT col_a AS feature, {sql_r6('nmi')} AS score, CASE WHEN (SELECT count(*) FROM kept) = 1 "
    "THEN col_a IN (SELECT feature FROM kept) ELSE col_a IN (SELECT feature FROM dominant) END AS selected FROM t",
)
def nmi_select(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    model = NMIFeatureSelector(featureCols=NMI_FEATURES, labelCol=NMI_TARGET, threshold=0.00001).fit(df)
    return model.support(spark).select("feature", r6("score").alias("score"), "selected")


# The price class and its coarse form both tell of the net class, and the first makes the second redundant.
@REG.add("nmi_select_transform", "SELECT l_orderkey, floor(l_extendedprice / 20000)::BIGINT AS dear FROM lineitem")
def nmi_select_transform(spark, sf_dir) -> DataFrame:
    df = derived(spark, sf_dir, "l_orderkey").withColumn("coarse", F.floor(F.col("dear") / 2))
    selector = NMIFeatureSelector(featureCols=["dear", "coarse", "reduced"], labelCol="net", keepCols=["l_orderkey"], threshold=0.01)
    return selector.fit(df).transform(df)


@REG.add("first_k_select", "SELECT l_quantity, l_extendedprice FROM lineitem")
def first_k_select(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return FirstKSelector().fit(df).transform(df)


@REG.add(
    "selector_inverse",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 0e0 AS l_discount, 0e0 AS l_tax FROM lineitem",
)
def selector_inverse(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    model = FirstKSelector(
        featureCols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], keepCols=["l_orderkey", "l_linenumber"]
    ).fit(df)
    return model.inverse_transform(model.transform(df))
