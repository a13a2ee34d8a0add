"""Shared pieces of the registered queries and of their SQL checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.tables import load_table

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, QueryFn]
    sql: dict[str, str]

    def add(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def registry() -> Registry:
    return Registry({}, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    """Six decimals, without a negative zero: sums of doubles have no fixed order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0e0)"


def sql_uniform(*parts: str | int) -> str:
    """The SQL form of ``hash_uniform``; text parts are SQL expressions."""
    joined = " || ':' || ".join(f"'{p}'" if isinstance(p, int) else p for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::BIGINT / 4294967296e0)"


def sql_left_code(x: str, lo: str, hi: str, k: str) -> str:
    step = f"(({hi} - {lo}) / ({k})::DOUBLE)"
    f = f"floor(({x} - {lo}) / nullif({step}, 0))"
    return (
        f"(CASE WHEN {hi} = {lo} THEN {k} - 1 ELSE greatest(0, least({k} - 1, "
        f"{f} - ({x} < {f} * {step} + {lo})::INT + ({x} >= ({f} + 1) * {step} + {lo})::INT)) END)::BIGINT"
    )


def sql_right_code(x: str, lo: str, hi: str, k: int) -> str:
    step = f"(({hi} - {lo}) / {k}e0)"
    f = f"(ceil(({x} - {lo}) / nullif({step}, 0)) - 1)"
    return (
        f"(CASE WHEN {x} IS NULL THEN {k + 1} WHEN {hi} = {lo} THEN {(k + 1) // 2 - 1} ELSE greatest(0, least({k - 1}, "
        f"{f} - ({x} <= {f} * {step} + {lo})::INT + ({x} > ({f} + 1) * {step} + {lo})::INT)) END)::BIGINT"
    )


def sql_iqr_params(source: str, cols: Sequence[str]) -> str:
    """Rows ``(feature, lo, hi, iqr, n, bins)`` of the automatic bin rule."""
    parts = [
        f"SELECT '{c}' AS feature, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, "
        f"quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS iqr, count(*) AS n FROM {source}"
        for c in cols
    ]
    union = " UNION ALL ".join(parts)
    return (
        "SELECT feature, lo, hi, iqr, n, greatest(2, ceil((hi - lo) / (2 * greatest(iqr, 1e-8) * pow(n, 1e0 / 3)) "
        f"* log2(n + 1)))::BIGINT AS bins FROM ({union})"
    )


def sql_iqr_codes(source: str, cols: Sequence[str], keep: Sequence[str] = ()) -> str:
    """The automatic left-closed codes of several columns next to kept columns."""
    codes = ", ".join(
        sql_left_code(f"{c}::DOUBLE", f"p_{c}.lo", f"p_{c}.hi", f"p_{c}.bins") + f" AS {c}" for c in cols
    )
    joins = " ".join(
        f"CROSS JOIN (SELECT * FROM ({sql_iqr_params(source, cols)}) WHERE feature = '{c}') p_{c}" for c in cols
    )
    lead = ", ".join(f"s.{c}" for c in keep)
    return f"SELECT {lead + ', ' if lead else ''}{codes} FROM {source} s {joins}"


def sql_cut_codes(source: str, cut: Sequence[str], keep: Sequence[str] = (), bins: int = 100) -> str:
    """Right-closed codes of several columns next to kept columns."""
    ranges = ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in cut)
    codes = ", ".join(sql_right_code(f"{c}::DOUBLE", f"lo_{c}", f"hi_{c}", bins) + f" AS {c}" for c in cut)
    lead = ", ".join(f"s.{c}" for c in keep)
    sep = ", " if lead and codes else ""
    if not cut:
        return f"SELECT {lead} FROM {source} s"
    return f"SELECT {lead}{sep}{codes} FROM {source} s CROSS JOIN (SELECT {ranges} FROM {source})"
