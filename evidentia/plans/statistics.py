"""Queries on sources, binning, counts, entropies and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binning import fit_left_closed, fit_right_closed, left_codes, right_codes
from evidentia.functions.sampling import hash_split as split_by_hash
from evidentia.functions.sampling import nested_sample as sample_by_hash
from evidentia.operators.bn_features import num_classes as count_classes
from evidentia.operators.counts import code_histogram, contingency_2d, enumerate_codes
from evidentia.operators.entropy import conditional_entropies, entropies, nmi, pair_entropies
from evidentia.plans.common import (
    r6, registry, sql_cut_codes, sql_iqr_codes, sql_iqr_params, sql_left_code, sql_r6, sql_uniform, table,
)
from evidentia.sources.tables import attach_target, split_target

REG = registry()
KEYS = ["l_orderkey", "l_linenumber"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_returnflag", "l_linestatus", "l_linenumber"]


@REG.add("scan_features", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem")
def scan_features(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    features, _ = split_target(df, "l_extendedprice")
    return features


@REG.add("labels_features_join", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def labels_features_join(spark, sf_dir) -> DataFrame:
    features = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return attach_target(features, table(spark, sf_dir, "labels"), "doc_id", how="inner")


@REG.add("iqr_bin_params", f"SELECT feature, lo, hi, {sql_r6('iqr')} AS iqr, n, bins FROM ({sql_iqr_params('lineitem', NUMERIC)})")
def iqr_bin_params(spark, sf_dir) -> DataFrame:
    specs = fit_left_closed(table(spark, sf_dir, "lineitem"), NUMERIC)
    rows = [(s.feature, s.lo, s.hi, s.iqr, s.n, s.bins) for s in specs.values()]
    return spark.createDataFrame(rows, "feature string, lo double, hi double, iqr double, n bigint, bins bigint").withColumn("iqr", r6("iqr"))


@REG.add("iqr_discretize", sql_iqr_codes("lineitem", NUMERIC, KEYS))
def iqr_discretize(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(*KEYS, *[code.alias(c) for c, code in left_codes(fit_left_closed(df, NUMERIC)).items()])


_FIXED = ", ".join(sql_left_code(c, f"min({c}) OVER ()", f"max({c}) OVER ()", "10") + f" AS {c}" for c in NUMERIC)


@REG.add("fixed_bin_discretize", f"SELECT l_orderkey, l_linenumber, {_FIXED} FROM lineitem")
def fixed_bin_discretize(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(*KEYS, *[code.alias(c) for c, code in left_codes(fit_left_closed(df, NUMERIC, 10)).items()])


@REG.add("cut_discretize", sql_cut_codes("lineitem", NUMERIC, KEYS))
def cut_discretize(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(*KEYS, *[code.alias(c) for c, code in right_codes(fit_right_closed(df, NUMERIC)).items()])


_GAPPED = "(SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05) AS l_discount, nullif(l_tax, 0.02) AS l_tax FROM lineitem)"


@REG.add("cut_discretize_nulls", sql_cut_codes(_GAPPED, ["l_discount", "l_tax"], KEYS))
def cut_discretize_nulls(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        *KEYS, F.nullif("l_discount", F.lit(0.05)).alias("l_discount"), F.nullif("l_tax", F.lit(0.02)).alias("l_tax")
    )
    return df.select(*KEYS, *[code.alias(c) for c, code in right_codes(fit_right_closed(df, ["l_discount", "l_tax"])).items()])


@REG.add("enumerate_codes", "SELECT p_type AS value, dense_rank() OVER (ORDER BY p_type) - 1 AS code, count(*) AS n FROM part GROUP BY p_type")
def enumerate_codes_query(spark, sf_dir) -> DataFrame:
    return enumerate_codes(table(spark, sf_dir, "part"), "p_type")


def _codes(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    codes = right_codes(fit_right_closed(df, ["l_quantity", "l_discount", "l_tax"]))
    return df.select(*CATEGORIES, *[code.alias(c) for c, code in codes.items()])


_CODES_SQL = sql_cut_codes("lineitem", ["l_quantity", "l_discount", "l_tax"], CATEGORIES)


@REG.add(
    "code_histogram",
    f"WITH h AS (SELECT l_discount AS code, count(*) AS n FROM ({_CODES_SQL}) GROUP BY 1) "
    "SELECT code, n, (SELECT max(code) + 1 - count(*) FROM h)::BIGINT AS empty_codes FROM h",
)
def code_histogram_query(spark, sf_dir) -> DataFrame:
    return code_histogram(_codes(spark, sf_dir), "l_discount")


@REG.add(
    "contingency_2d",
    f"WITH h AS (SELECT l_discount AS x, l_tax AS y, count(*) AS n FROM ({_CODES_SQL}) GROUP BY 1, 2) SELECT x, y, n, "
    "(SELECT (max(x) - min(x) + 1) * (max(y) - min(y) + 1) - count(*) FROM h)::BIGINT AS empty_cells FROM h",
)
def contingency_2d_query(spark, sf_dir) -> DataFrame:
    return contingency_2d(_codes(spark, sf_dir), "l_discount", "l_tax")


_ENTROPY_COLS = [*CATEGORIES, "l_quantity", "l_discount", "l_tax"]
_ENTROPY = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_r6('-sum(n / t * log2(n / t))')} AS entropy FROM "
    f"(SELECT n, sum(n) OVER () AS t FROM (SELECT count(*)::DOUBLE AS n FROM codes GROUP BY {c}))"
    for c in _ENTROPY_COLS
)


@REG.add("entropy_columns", f"WITH codes AS ({_CODES_SQL}) {_ENTROPY}")
def entropy_columns(spark, sf_dir) -> DataFrame:
    return entropies(_codes(spark, sf_dir), _ENTROPY_COLS).select("feature", r6("entropy").alias("entropy"))


_GIVENS = [["l_returnflag"], ["l_discount"], ["l_returnflag", "l_tax"], ["l_returnflag", "l_discount", "l_linenumber"]]


def _conditional_sql(given: list[str]) -> str:
    keys = ", ".join(given)
    return (
        f"SELECT '{','.join(given)}' AS given, {sql_r6('-sum(n * log2(n / m)) / sum(n)')} AS conditional_entropy FROM "
        f"(SELECT n, sum(n) OVER (PARTITION BY {keys}) AS m FROM "
        f"(SELECT {keys}, l_linestatus, count(*)::DOUBLE AS n FROM codes GROUP BY ALL))"
    )


@REG.add("conditional_entropy", f"WITH codes AS ({_CODES_SQL}) " + " UNION ALL ".join(map(_conditional_sql, _GIVENS)))
def conditional_entropy_query(spark, sf_dir) -> DataFrame:
    h = conditional_entropies(_codes(spark, sf_dir), "l_linestatus", _GIVENS)
    return h.select("given", r6("conditional_entropy").alias("conditional_entropy"))


# Normalised mutual information. Binned columns carry gaps in the counts form, the others do not.
NMI_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]
NMI_TARGET = "l_returnflag"
NMI_BINNED = {"l_quantity", "l_discount", "l_tax"}


def sql_entropy(cols: list[str], mode: str, codes: str = "codes") -> str:
    """Scalar subquery: the entropy of one column or the joint entropy of two."""
    keys = ", ".join(cols)
    if mode == "standard":
        return f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*)::DOUBLE AS n FROM {codes} GROUP BY {keys}))"
    low = {c: f"min({c})" if len(cols) > 1 else "0" for c in cols}
    spans = " * ".join(f"max({c}) - {low[c]} + 1" if c in NMI_BINNED else f"count(DISTINCT {c})" for c in cols)
    spans = " * ".join(f"({s})" for s in spans.split(" * "))
    return (
        "(SELECT log2(t) - (s + CASE WHEN t > o THEN (t - o) * log2(t - o) ELSE 0 END) / t FROM (SELECT "
        f"(SELECT ({spans})::DOUBLE FROM {codes}) AS t, sum(c) AS o, sum(c * log2(c)) AS s FROM (SELECT count(*)::DOUBLE AS c FROM "
        f"(SELECT count(*) AS n FROM {codes} GROUP BY {keys}) GROUP BY n)))"
    )


def sql_nmi(pairs: list[tuple[str, str]], mode: str) -> str:
    parts = [
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {sql_entropy([a], mode)} AS h_a, {sql_entropy([b], mode)} AS h_b, "
        f"{sql_entropy([a, b], mode)} AS h_ab"
        for a, b in pairs
    ]
    return (
        "SELECT col_a, col_b, h_a, h_b, h_ab, (h_a + h_b - h_ab) / nullif(2 * greatest(h_a, h_b), 0) AS nmi FROM ("
        + " UNION ALL ".join(parts) + ")"
    )


NMI_CODES_SQL = _CODES_SQL
_TO_TARGET = [(c, NMI_TARGET) for c in NMI_FEATURES]
_ROUNDED = ", ".join(f"{sql_r6(c)} AS {c}" for c in ("h_a", "h_b", "h_ab", "nmi"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("col_a", "col_b", *[r6(c).alias(c) for c in ("h_a", "h_b", "h_ab", "nmi")])


@REG.add("nmi_standard", f"WITH codes AS ({_CODES_SQL}) SELECT col_a, col_b, {_ROUNDED} FROM ({sql_nmi(_TO_TARGET, 'standard')})")
def nmi_standard(spark, sf_dir) -> DataFrame:
    return _rounded(nmi(table(spark, sf_dir, "lineitem"), _TO_TARGET, "standard"))


@REG.add("nmi_counts", f"WITH codes AS ({_CODES_SQL}) SELECT col_a, col_b, {_ROUNDED} FROM ({sql_nmi(_TO_TARGET, 'counts')})")
def nmi_counts(spark, sf_dir) -> DataFrame:
    return _rounded(nmi(table(spark, sf_dir, "lineitem"), _TO_TARGET, "counts"))


_COUNT_ENTRIES = [*[(c, None) for c in [*NMI_FEATURES, NMI_TARGET]], *_TO_TARGET]
_COUNT_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b or ''}' AS col_b, {sql_r6(sql_entropy([c for c in (a, b) if c], 'counts'))} AS h"
    for a, b in _COUNT_ENTRIES
)


@REG.add("nmi_count_entropy", f"WITH codes AS ({_CODES_SQL}) {_COUNT_SQL}")
def nmi_count_entropy(spark, sf_dir) -> DataFrame:
    h = pair_entropies(table(spark, sf_dir, "lineitem"), _COUNT_ENTRIES, "counts")
    at = F.col("entry") + 1
    names = [F.element_at(F.array(*[F.lit(e[i] or "") for e in _COUNT_ENTRIES]), at).alias(f"col_{'ab'[i]}") for i in (0, 1)]
    return h.select(*names, r6("h").alias("h"))


@REG.add(
    "num_classes",
    "SELECT 'o_orderpriority' AS label, count(*) AS classes FROM (SELECT DISTINCT o_orderpriority FROM orders) UNION ALL "
    "SELECT 'o_orderstatus', count(*) FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') FROM orders)",
)
def num_classes(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = count_classes(orders, "o_orderpriority").withColumn("label", F.lit("o_orderpriority"))
    gapped = orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    second = count_classes(gapped, "o_orderstatus").withColumn("label", F.lit("o_orderstatus"))
    return first.unionByName(second).select("label", "classes")


@REG.add("nested_sample", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {sql_uniform('o_orderkey::VARCHAR', 7)} < 0.4")
def nested_sample(spark, sf_dir) -> DataFrame:
    return sample_by_hash(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 0.4, 7)


@REG.add(
    "hash_split",
    f"SELECT o_orderkey, CASE WHEN {sql_uniform('o_orderkey::VARCHAR', 42)} < 0.7 THEN 'train' ELSE 'test' END AS part FROM orders",
)
def hash_split(spark, sf_dir) -> DataFrame:
    train, test = split_by_hash(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.7, 42)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@REG.add("first_n", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 50")
def first_n(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(50)


@REG.add(
    "batch_union",
    "SELECT vec_id, label, 'even' AS batch FROM embeddings WHERE label % 2 = 0 UNION ALL "
    "SELECT vec_id, label, 'odd' AS batch FROM embeddings WHERE label % 2 <> 0",
)
def batch_union(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    even = vectors.where(F.col("label") % 2 == 0).withColumn("batch", F.lit("even"))
    odd = vectors.where(F.col("label") % 2 != 0).withColumn("batch", F.lit("odd"))
    return even.unionByName(odd)


