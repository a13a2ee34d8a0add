"""Entropies, conditional entropies, causal effects and normalised mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binning import DEFAULT_BINS
from evidentia.functions.information import entropy_of_counts, n_log_n
from evidentia.operators.counts import category_columns, contingency, plain_key


def entropies(codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Base-2 entropy of each column, all in one shuffle: ``(feature, entropy)``."""
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), plain_key(codes, c).alias("code")) for c in cols]))
    counts = contingency(codes.select(keys.alias("e")), ["e.feature", "e.code"])
    return counts.groupBy("feature").agg(entropy_of_counts(F.col("n")).alias("entropy"))


def conditional_entropies(codes: DataFrame, target: str, givens: Sequence[Sequence[str]]) -> DataFrame:
    """H(target given columns) for several column lists in one shuffle: ``(given, conditional_entropy)``.

    Grouped sums per cell, then per condition. No window, so a condition that holds most of the
    cells costs no more than a partial sum.
    """
    variants = [
        F.struct(F.lit(",".join(g)).alias("given"), F.array(*[plain_key(codes, c) for c in g]).alias("o")) for g in givens
    ]
    cells = contingency(codes.select(F.explode(F.array(*variants)).alias("v"), F.col(target).alias("y")), ["v.given", "v.o", "y"])
    strata = cells.groupBy("given", "o").agg(n_log_n(F.col("n")).alias("cell_nlogn"), F.sum("n").alias("n"))
    n = F.col("n")
    value = (n_log_n(n) - F.sum("cell_nlogn")) / F.sum(n)
    return strata.groupBy("given").agg(F.greatest(F.lit(0.0), value).alias("conditional_entropy"))


def effect_cells(cells: DataFrame, target: str, steps: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Counts by ``(step, o, x, y)`` for several ``(feature, controls)`` steps in one shuffle.

    ``o`` is the array of the controls' codes itself, not a hash of it.
    """
    no_code = F.array().cast("array<bigint>")
    variants = [
        F.struct(
            F.lit(i).alias("step"),
            (F.array(*[F.col(c) for c in controls]) if controls else no_code).alias("o"),
            F.col(feature).alias("x"),
        )
        for i, (feature, controls) in enumerate(steps)
    ]
    return (
        cells.select(F.explode(F.array(*variants)).alias("v"), F.col(target).alias("y"), "n")
        .groupBy("v.step", "v.o", "v.x", "y")
        .agg(F.sum("n").alias("n"))
    )


def causal_effects(cells: DataFrame, target: str, steps: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Causal effect of every step's feature on the target given its controls.

    ``cells`` is a contingency table with counts ``n``. The result ``(step, effect, dependent)``
    holds the conditional mutual information in bits, and whether it is truly above zero:
    an exact integer comparison of ``n * n_o`` with ``n_ox * n_oy`` in every observed cell, so
    rounding never decides. Marginals come back by joins rather than windows, since a single
    condition may hold a large part of the cells.
    """
    g = effect_cells(cells, target, steps)
    ox = g.groupBy("step", "o", "x").agg(F.sum("n").alias("n_ox"))
    oy = g.groupBy("step", "o", "y").agg(F.sum("n").alias("n_oy"))
    o = oy.groupBy("step", "o").agg(F.sum("n_oy").alias("n_o"))
    joined = g.join(ox, ["step", "o", "x"]).join(oy, ["step", "o", "y"]).join(o, ["step", "o"])
    whole = [F.col(c).cast("decimal(18,0)") for c in ("n", "n_o", "n_ox", "n_oy")]
    n, n_o, n_ox, n_oy = [F.col(c).cast("double") for c in ("n", "n_o", "n_ox", "n_oy")]
    return joined.groupBy("step").agg(
        F.greatest(F.lit(0.0), F.sum(n * F.log2(n * n_o / (n_ox * n_oy))) / F.sum(n)).alias("effect"),
        F.bool_or(whole[0] * whole[1] != whole[2] * whole[3]).alias("dependent"),
    )


def _entry(index: int, a: Column, b: Column | None) -> Column:
    empty = F.struct(F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("string").alias("s"))
    return F.struct(F.lit(index).alias("entry"), a.alias("a"), (empty if b is None else b).alias("b"))


@dataclass
class CodedTable:
    """Category keys of some columns, computed once per row: what any number of entropy jobs can count."""

    rows: DataFrame
    place: dict[str, str]
    binned: set[str]

    @classmethod
    def of(cls, df: DataFrame, cols: Sequence[str], mode: str, bin_count: int) -> CodedTable:
        keys, binned = category_columns(df, cols, bin_count, bin_booleans=mode == "counts")
        place = {c: f"k{i}" for i, c in enumerate(keys)}
        return cls(df.select(*[key.alias(place[c]) for c, key in keys.items()]), place, binned)


def pair_entropies(
    df: DataFrame | CodedTable,
    entries: Sequence[tuple[str, str | None]],
    mode: str = "standard",
    bin_count: int = DEFAULT_BINS,
) -> DataFrame:
    """Entropy of single columns (second name ``None``) and joint entropy of pairs: one shuffle of
    the rows counts every entry. Result ``(entry, h)``.

    ``standard`` is the entropy of the categories. ``counts`` takes the list of counts, empty
    cells included, as if the counts were the observations. Every column of a pair needs its own
    single entry in that mode.
    """
    if mode not in ("standard", "counts"):
        raise ValueError(f"unknown mode {mode}")
    names = [c for pair in entries for c in pair if c is not None]
    # The codes are computed once per row in a projection below the explode.
    table = df if isinstance(df, CodedTable) else CodedTable.of(df, names, mode, bin_count)
    coded, place, binned = table.rows, table.place, table.binned
    listed = [
        _entry(i, F.col(place[a]), None if b is None else F.col(place[b])) for i, (a, b) in enumerate(entries)
    ]
    cells = contingency(coded.select(F.explode(F.array(*listed)).alias("e")), ["e.entry", "e.a", "e.b"])
    if mode == "standard":
        h = cells.groupBy("entry").agg(entropy_of_counts(F.col("n")).alias("h"))
    else:
        h = _count_entropies(cells, entries, binned)
    return h


def _spread(stats: DataFrame, value: Column, listed: Sequence[Column]) -> DataFrame:
    """One row per listed struct next to the map ``m`` from entry to its value.

    There is a value per column or pair, so the map is small; spreading it costs one pass over the
    entries where self-joins would read the counts once for each side.
    """
    one = stats.agg(F.map_from_entries(F.collect_list(F.struct("entry", value))).alias("m"))
    return one.select(F.explode(F.array(*listed)).alias("p"), "m")


def _count_entropies(cells: DataFrame, entries: Sequence[tuple[str, str | None]], binned: set[str]) -> DataFrame:
    """Entropy of the count list. Binned columns leave gaps in the code range, enumerated ones do
    not; the gaps are counted by arithmetic and join the list as zeros."""
    per_count = cells.groupBy("entry", "n").agg(
        F.count(F.lit(1)).alias("c"), F.min("a.i").alias("a_lo"), F.max("a.i").alias("a_hi"),
        F.min("b.i").alias("b_lo"), F.max("b.i").alias("b_hi"),
    )
    per_entry = per_count.groupBy("entry").agg(
        F.sum("c").alias("observed"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("clogc"),
        F.min("a_lo").alias("a_lo"), F.max("a_hi").alias("a_hi"), F.min("b_lo").alias("b_lo"), F.max("b_hi").alias("b_hi"),
    )
    single = {a: i for i, (a, b) in enumerate(entries) if b is None}
    listed = [
        F.struct(
            F.lit(i).alias("entry"), F.lit(single[a]).alias("a"), F.lit(None if b is None else single[b]).cast("int").alias("b"),
            F.lit(a in binned).alias("a_gaps"), F.lit(b in binned).alias("b_gaps"),
        )
        for i, (a, b) in enumerate(entries)
    ]
    spread = _spread(per_entry, F.struct("observed", "clogc", "a_lo", "a_hi", "b_lo", "b_hi"), listed)
    own = F.col("m")[F.col("p.entry")]

    def span(name: str) -> Column:
        # How far the codes of one column reach: a binned column's observed codes, from zero in the
        # list of one column and from the least code in a pair; otherwise its distinct values.
        low = own[f"{name}_lo"] if name == "b" else F.when(F.col("p.b").isNull(), F.lit(0)).otherwise(own["a_lo"])
        return F.when(F.col(f"p.{name}_gaps"), own[f"{name}_hi"] - low + 1).otherwise(F.col("m")[F.col(f"p.{name}")]["observed"])

    cells_all = span("a") * F.when(F.col("p.b").isNull(), F.lit(1)).otherwise(span("b"))
    empty = cells_all - own["observed"]
    total = cells_all.cast("double")
    empty_term = F.when(empty > 0, empty * F.log2(empty.cast("double"))).otherwise(F.lit(0.0))
    h = F.log2(total) - (own["clogc"] + empty_term) / total
    return spread.select(F.col("p.entry").alias("entry"), F.greatest(F.lit(0.0), h).alias("h"))


def nmi(
    df: DataFrame | CodedTable, pairs: Sequence[tuple[str, str]], mode: str = "standard", bin_count: int = DEFAULT_BINS
) -> DataFrame:
    """``(col_a, col_b, h_a, h_b, h_ab, nmi)`` with nmi = (Ha + Hb - Hab) / (2 max(Ha, Hb)), null when
    both entropies are zero."""
    singles = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(singles)}
    h = pair_entropies(df, [(c, None) for c in singles] + list(pairs), mode, bin_count)
    listed = [
        F.struct(
            F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
            F.lit(at[a]).alias("a"), F.lit(at[b]).alias("b"), F.lit(len(singles) + i).alias("ab"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    found = _spread(h, F.col("h"), listed).select(
        "p.col_a", "p.col_b", *[F.col("m")[F.col(f"p.{e}")].alias(f"h_{e}") for e in ("a", "b", "ab")]
    )
    peak = F.greatest("h_a", "h_b")
    value = (F.col("h_a") + F.col("h_b") - F.col("h_ab")) / F.when(peak > 1e-12, 2 * peak)
    return found.withColumn("nmi", value)
