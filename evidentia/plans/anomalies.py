"""Queries on outliers in tables and event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.sampling import bottom_k
from evidentia.operators.families import cardinalities, compress, named_bic_scores
from evidentia.operators.lof import PlaceFactors, bagged_lof, exact_lof
from evidentia.operators.outliers import TabularOutlierDetector, random_bags
from evidentia.operators.sequences import SequenceOutlierDetector, previous_values
from evidentia.plans.common import r6, registry, sql_r6, sql_uniform, table
from evidentia.plans.networks import sql_bic, sql_cpt
from evidentia.session import cut_lineage

REG = registry()
K = 5
COMPONENTS = 64


def vectors(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(COMPONENTS)])


_VECTORS = "(SELECT vec_id AS id, " + ", ".join(f"embedding[{j + 1}]::DOUBLE AS e{j}" for j in range(COMPONENTS)) + " FROM embeddings)"


def sql_lof(source: str, cols: list[str], tag: str = "") -> str:
    """Named steps that end in ``lof<tag>(id, lof)`` by comparing all rows with all rows."""
    square = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    return (
        f"near{tag} AS (SELECT * FROM (SELECT a.id, b.id AS nb, sqrt({square}) AS dist, rank() OVER (PARTITION BY a.id ORDER BY sqrt({square})) AS rk "
        f"FROM {source} a JOIN {source} b ON a.id <> b.id) WHERE rk <= {K}), "
        f"kd{tag} AS (SELECT id, max(dist) AS kd FROM near{tag} GROUP BY id), "
        f"lrd{tag} AS (SELECT n.id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM near{tag} n JOIN kd{tag} k ON k.id = n.nb GROUP BY n.id), "
        f"lof{tag} AS (SELECT n.id, avg(b.lrd) / any_value(a.lrd) AS lof FROM near{tag} n JOIN lrd{tag} b ON b.id = n.nb "
        f"JOIN lrd{tag} a ON a.id = n.id GROUP BY n.id)"
    )


@REG.add("lof_exact", f"WITH v AS {_VECTORS}, {sql_lof('v', ['e0', 'e1'])} SELECT id AS vec_id, {sql_r6('lof')} AS lof FROM lof")
def lof_exact(spark, sf_dir) -> DataFrame:
    return exact_lof(vectors(spark, sf_dir), ["e0", "e1"], K).select("vec_id", r6("lof").alias("lof"))


WIDE = [f"e{j}" for j in range(COMPONENTS)]


@REG.add("lof_wide", f"WITH v AS {_VECTORS}, {sql_lof('v', WIDE)} SELECT id AS vec_id, {sql_r6('lof')} AS lof FROM lof")
def lof_wide(spark, sf_dir) -> DataFrame:
    return exact_lof(vectors(spark, sf_dir), WIDE, K).select("vec_id", r6("lof").alias("lof"))


BAGS = random_bags(WIDE, 5, 4, 11)
_SCALED = " + ".join(f"(l{i}.lof - (SELECT min(lof) FROM lof{i})) / ((SELECT max(lof) - min(lof) FROM lof{i}))" for i in range(len(BAGS)))
_JOINED = " ".join(f"JOIN lof{i} l{i} USING (id)" for i in range(1, len(BAGS)))


@REG.add(
    "lof_bagged",
    f"WITH v AS {_VECTORS}, " + ", ".join(sql_lof("v", bag, str(i)) for i, bag in enumerate(BAGS))
    + f" SELECT l0.id AS vec_id, {sql_r6(f'({_SCALED}) / {len(BAGS)}')} AS lof_score FROM lof0 l0 {_JOINED}",
)
def lof_bagged(spark, sf_dir) -> DataFrame:
    return bagged_lof(vectors(spark, sf_dir), BAGS, K).select("vec_id", r6("lof_score").alias("lof_score"))


ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BAG = ["l_quantity", "l_extendedprice"]
REFERENCE, SEED = 256, 3
_ID = " || ':' || ".join(f"{c}::VARCHAR" for c in ROW_KEYS)


def sql_reference_lof() -> str:
    """Named steps that end in ``lof(rid, lof)``: every row, numbered, against the reference rows."""
    square = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in BAG)
    order = ", ".join([sql_uniform(*[f"{c}::VARCHAR" for c in ROW_KEYS], SEED), *ROW_KEYS])
    nearest = f"b.id AS nb, sqrt({square}) AS dist, rank() OVER (PARTITION BY a.rid ORDER BY sqrt({square})) AS rk"
    return (
        f"rows_ AS MATERIALIZED (SELECT *, {_ID} AS id, row_number() OVER () AS rid FROM lineitem), "
        f"refs AS MATERIALIZED (SELECT * FROM rows_ ORDER BY {order} LIMIT {REFERENCE}), "
        f"rnear AS (SELECT * FROM (SELECT a.id, {nearest} FROM refs a JOIN refs b ON a.id <> b.id) WHERE rk <= {K}), "
        "kd AS (SELECT id, max(dist) AS kd FROM rnear GROUP BY id), "
        "lrd AS (SELECT n.id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM rnear n JOIN kd k ON k.id = n.nb GROUP BY n.id), "
        f"near AS (SELECT * FROM (SELECT a.rid, {nearest} FROM rows_ a JOIN refs b ON a.id <> b.id) WHERE rk <= {K}), "
        "lof AS (SELECT n.rid, avg(l.lrd) * (avg(greatest(n.dist, k.kd)) + 1e-10) AS lof FROM near n JOIN lrd l ON l.id = n.nb "
        "JOIN kd k ON k.id = n.nb GROUP BY n.rid)"
    )


@REG.add(
    "lof_sampled",
    f"WITH {sql_reference_lof()} SELECT {', '.join(ROW_KEYS)}, {sql_r6('lof')} AS lof FROM rows_ JOIN lof USING (rid)",
)
def lof_sampled(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, *BAG)
    reference = cut_lineage(bottom_k(df, ROW_KEYS, REFERENCE, SEED))
    fitted = PlaceFactors.fit(reference, BAG, K)
    others = df.join(F.broadcast(reference.select(*ROW_KEYS)), ROW_KEYS, "left_anti")
    scored = fitted.score(reference).unionByName(fitted.score(others, apart=True))
    return scored.select(*ROW_KEYS, r6("lof").alias("lof"))


PLACE, K_ROWS = ["l_quantity", "l_discount", "l_tax"], 20


def sql_place_lof(cols: list[str], k: int, source: str = "lineitem") -> str:
    """Named steps that end in ``lof(cols, lof)``: the factor of every place, rows at the same place counted one by one."""
    listed = ", ".join(cols)
    square = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    return (
        f"spots AS MATERIALIZED (SELECT {listed}, count(*) AS w, row_number() OVER () AS s FROM {source} GROUP BY {listed}), "
        f"far AS (SELECT a.s, b.s AS nb, a.w - 1 AS copies, b.w, sqrt({square}) AS dist FROM spots a JOIN spots b ON a.s <> b.s WHERE a.w <= {k}), "
        "upto AS (SELECT *, copies + sum(w) OVER (PARTITION BY s ORDER BY dist) - sum(w) OVER (PARTITION BY s, dist) AS before FROM far), "
        f"near AS MATERIALIZED (SELECT * FROM upto WHERE before < {k}), "
        "kd AS (SELECT s, max(dist) AS kd, any_value(copies) AS copies FROM near GROUP BY s), "
        "lrd AS (SELECT n.s, any_value(k.kd) AS kd, any_value(k.copies) AS copies, sum(n.w) + any_value(k.copies) AS total, "
        "1 / ((sum(n.w * greatest(n.dist, coalesce(o.kd, 0))) + any_value(k.copies * k.kd)) / (sum(n.w) + any_value(k.copies)) + 1e-10) AS lrd "
        "FROM near n JOIN kd k USING (s) LEFT JOIN kd o ON o.s = n.nb GROUP BY n.s), "
        "fac AS (SELECT n.s, (sum(n.w * coalesce(o.lrd, 1e10)) + any_value(l.copies * l.lrd)) / any_value(l.total) / any_value(l.lrd) AS lof "
        "FROM near n JOIN lrd l USING (s) LEFT JOIN lrd o ON o.s = n.nb GROUP BY n.s), "
        f"lof AS MATERIALIZED (SELECT {listed}, coalesce(lof, 1) AS lof FROM spots LEFT JOIN fac USING (s))"
    )


@REG.add(
    "lof_rows",
    f"WITH {sql_place_lof(PLACE, K_ROWS)} SELECT {', '.join(ROW_KEYS)}, {sql_r6('lof')} AS lof FROM lineitem JOIN lof USING ({', '.join(PLACE)})",
)
def lof_rows(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*ROW_KEYS, *PLACE)
    return exact_lof(df, PLACE, K_ROWS).select(*ROW_KEYS, r6("lof").alias("lof"))


CATEGORIES = ["l_returnflag", "l_linestatus", "l_suppkey"]
EDGES = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_suppkey")]
SCORED_NODES = ["l_linestatus", "l_suppkey"]
NUMERIC_PARENTS = {"l_extendedprice": ["l_returnflag", "l_linestatus"]}


def sql_network_raw(rows: str = "rows_") -> str:
    """``raw``: every numbered row with the three raw network scores."""
    return (
        f"raw AS (SELECT {', '.join([*ROW_KEYS, *PLACE])}, rid, -ln(s.prob) AS s1, -ln(k.prob) AS s2, abs(d.l_extendedprice - g.mean) / g.sd AS s3 "
        f"FROM {rows} d JOIN {sql_cpt('l_linestatus', ['l_returnflag'])} s USING (l_returnflag, l_linestatus) "
        f"JOIN {sql_cpt('l_suppkey', ['l_returnflag'])} k USING (l_returnflag, l_suppkey) "
        "JOIN (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY ALL) g "
        "USING (l_returnflag, l_linestatus))"
    )


_BN = " + ".join(f"(s{i} - (SELECT min(s{i}) FROM raw)) / (SELECT max(s{i}) - min(s{i}) FROM raw)" for i in (1, 2, 3))
_BN = f"(({_BN}) / 3)"
_LOF = "((lof - (SELECT min(lof) FROM lof)) / (SELECT max(lof) - min(lof) FROM lof))"
_COMBINED = (
    f"WITH {sql_place_lof(PLACE, K_ROWS)}, {sql_network_raw('(SELECT *, row_number() OVER () AS rid FROM lineitem)')}, scores AS (SELECT {', '.join(ROW_KEYS)}, {_LOF} AS lof_score, {_BN} AS bn_score, "
    f"0.5e0 * {_LOF} + 0.5e0 * {_BN} AS score FROM raw JOIN lof USING ({', '.join(PLACE)})), "
    "cutoff AS (SELECT quantile_cont(score, 0.95) AS cutoff FROM scores) "
)
_KEYS = ", ".join(ROW_KEYS)


def detector(bags: list[list[str]] | None) -> TabularOutlierDetector:
    return TabularOutlierDetector(
        keyCols=ROW_KEYS, numericCols=PLACE if bags else [], categoryCols=CATEGORIES, knownStructure=EDGES, numericParents=NUMERIC_PARENTS,
        bags=bags, nodes=SCORED_NODES, neighbours=K_ROWS, contamination=0.05, seed=SEED,
    )


def _lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ROW_KEYS, *PLACE, "l_extendedprice", "l_returnflag", "l_linestatus")


@REG.add("bn_anomaly", f"WITH {sql_network_raw('(SELECT *, row_number() OVER () AS rid FROM lineitem)')} SELECT {_KEYS}, {sql_r6(_BN)} AS bn_score FROM raw")
def bn_anomaly(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    return detector(None).fit(df).transform(df).select(*ROW_KEYS, r6("bn_score").alias("bn_score"))


@REG.add(
    "combined_anomaly",
    _COMBINED + f"SELECT {_KEYS}, {sql_r6('lof_score')} AS lof_score, {sql_r6('bn_score')} AS bn_score, {sql_r6('score')} AS score FROM scores",
)
def combined_anomaly(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    scored = detector([PLACE]).fit(df).transform(df)
    return scored.select(*ROW_KEYS, *[r6(c).alias(c) for c in ("lof_score", "bn_score", "score")])


@REG.add(
    "outlier_predict",
    _COMBINED + f"SELECT {_KEYS}, CASE WHEN score > cutoff THEN -1 ELSE 1 END AS prediction FROM scores CROSS JOIN cutoff",
)
def outlier_predict(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    return detector([PLACE]).fit(df).predict(df).select(*ROW_KEYS, "prediction")


@REG.add(
    "outlier_decision",
    _COMBINED + f"SELECT {_KEYS}, {sql_r6('cutoff - score')} AS decision FROM scores CROSS JOIN cutoff",
)
def outlier_decision(spark, sf_dir) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    return detector([PLACE]).fit(df).decision_function(df).select(*ROW_KEYS, r6("decision").alias("decision"))


_TS = (
    "WITH seq AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events), "
    f"pairs AS (SELECT previous, event_type FROM seq WHERE previous IS NOT NULL), cpt AS (SELECT * FROM {sql_cpt('event_type', ['previous'], 'pairs')}), "
    "scores AS (SELECT event_id, user_id, event_type, seq.previous, CASE WHEN seq.previous IS NOT NULL THEN -ln(prob) END AS score FROM seq "
    "LEFT JOIN cpt USING (previous, event_type)), cutoff AS (SELECT quantile_cont(score, 0.95) AS cutoff FROM scores) "
    f"SELECT event_id, user_id, event_type, previous, {sql_r6('score')} AS score, "
    "CASE WHEN score > cutoff THEN -1 ELSE 1 END AS prediction FROM scores CROSS JOIN cutoff"
)


@REG.add("ts_anomaly", _TS)
def ts_anomaly(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    model = SequenceOutlierDetector(entityCol="user_id", orderCols=["ts", "event_id"], stateCol="event_type").fit(df)
    return model.transform(df).select("event_id", "user_id", "event_type", "previous", r6("score").alias("score"), "prediction")


STATES = ["event_type", "band"]
SLICES = [("event_type", "event_type"), ("event_type", "band"), ("band", "band")]
_BANDED = "(SELECT event_id, ts, user_id, event_type, least(4, floor(value / 40))::BIGINT AS band FROM events)"


def banded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.least(F.lit(4), F.floor(F.col("value") / 40)).alias("band"))


_SLICED = (
    f"WITH seq AS (SELECT event_id, user_id, event_type, band, lag(event_id) OVER w AS earlier, lag(event_type) OVER w AS previous_event_type, lag(band) OVER w AS previous_band "
    f"FROM {_BANDED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), pairs AS (SELECT * FROM seq WHERE earlier IS NOT NULL AND event_type IS NOT NULL "
    "AND band IS NOT NULL AND previous_event_type IS NOT NULL AND previous_band IS NOT NULL), "
)
_TWO_STATES = (
    _SLICED + f"a AS (SELECT * FROM {sql_cpt('event_type', ['previous_event_type'], 'pairs')}), b AS (SELECT * FROM {sql_cpt('band', ['previous_event_type', 'previous_band'], 'pairs')}), "
    "scores AS (SELECT event_id, user_id, CASE WHEN earlier IS NOT NULL THEN -ln(coalesce(a.prob, 0.5)) - ln(coalesce(b.prob, 0.5)) END AS score FROM seq "
    "LEFT JOIN a USING (previous_event_type, event_type) LEFT JOIN b USING (previous_event_type, previous_band, band)), cutoff AS (SELECT quantile_cont(score, 0.95) AS cutoff FROM scores) "
    f"SELECT event_id, user_id, {sql_r6('score')} AS score, CASE WHEN score > cutoff THEN -1 ELSE 1 END AS prediction FROM scores CROSS JOIN cutoff"
)


@REG.add("ts_anomaly_states", _TWO_STATES)
def ts_anomaly_states(spark, sf_dir) -> DataFrame:
    """Several states in a two-slice network whose edges are given."""
    df = banded(spark, sf_dir)
    model = SequenceOutlierDetector(entityCol="user_id", orderCols=["ts", "event_id"], stateCols=STATES, sliceEdges=SLICES).fit(df)
    return model.transform(df).select("event_id", "user_id", r6("score").alias("score"), "prediction")


def _searched_sql() -> str:
    """The greedy choice of every state's parents among two states before, from the scores of the four sets."""
    source, before = "pairs", [f"previous_{c}" for c in STATES]
    sets = [[], before[:1], before[1:], before]
    scores = ", ".join(
        f"{c}_scores AS (SELECT {', '.join(f'{sql_bic(c, p, source)} - 0.1e0 * {len(p)} AS s{i}' for i, p in enumerate(sets))})" for c in STATES
    )
    chosen = "CASE WHEN greatest(s1, s2) <= s0 THEN 0 WHEN s3 > greatest(s1, s2) THEN 3 WHEN s1 >= s2 THEN 1 ELSE 2 END"
    names = "CASE i " + " ".join(f"WHEN {i} THEN '{','.join(p)}'" for i, p in enumerate(sets)) + " END"
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS state, {names} AS parents, {sql_r6('CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END')} AS score FROM (SELECT *, {chosen} AS i FROM {c}_scores)" for c in STATES
    )
    return _SLICED + scores + " " + rows


@REG.add("ts_slice_edges", _searched_sql())
def ts_slice_edges(spark, sf_dir) -> DataFrame:
    """Which states depend on which states before, searched between the slices alone; the score of each state's family."""
    df = banded(spark, sf_dir)
    model = SequenceOutlierDetector(entityCol="user_id", orderCols=["ts", "event_id"], stateCols=STATES).fit(df)
    rows = previous_values(df, "user_id", ["ts", "event_id"], model.before, "met").where("met").dropna()
    nodes = model.network.nodes
    counts = compress(rows, nodes)
    families = [(c, tuple(model.network.parents[c])) for c in STATES]
    scored = named_bic_scores(counts, families, cardinalities(counts, nodes))
    penalty = F.when(F.col("parents") == "", 0.0).otherwise(F.size(F.split("parents", ",")) * 0.1)
    return scored.select(F.col("node").alias("state"), "parents", r6(F.col("score") - penalty).alias("score"))
