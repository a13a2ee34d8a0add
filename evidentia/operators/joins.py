"""Joins with a few very frequent keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.session import cut_lineage

HOT_SHARE = 0.001  # of the rows on one key, beyond which it is joined apart
HOT_BYTES = 64 << 20  # of the small side's rows for those keys
SALTS = 1024


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``(keys..., rows)``: how many rows every key without nulls has."""
    full = df.dropna(subset=list(keys))
    return full.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("rows"))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def split_join(
    rows: DataFrame, side: DataFrame, keys: Sequence[str], counts: DataFrame | None = None, share: float = HOT_SHARE,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Left join of ``rows`` with ``side``, which has at most one row a key, where keys may hold any share of the rows.

    Keys that hold more than ``share`` of the rows are at most ``1 / share``; their rows of ``side`` are broadcast if they fit
    ``hot_bytes`` (counted from their JSON form). All other keys are joined by exchange, where none holds more than ``share``; rows that
    have their match already or that hold a null in a key, which finds none, spread evenly over that exchange. ``counts`` (keys and
    ``rows``) saves a count of ``rows`` if it is known; a stream can't be counted and has none joined apart. ``rows`` is read once, and once more where they are counted.
    Where every key is frequent, no row is moved.
    """
    keys = list(keys)
    other = [c for c in side.columns if c not in keys]
    clash = set(other) & set(rows.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    col = lambda c: F.col(f"`{c}`")
    if counts is None and not rows.isStreaming:
        counts = cut_lineage(key_counts(rows, keys))
    total, named_keys = 0, 0
    if counts is not None:
        total, named_keys = counts.dropna(subset=keys).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    hot = counts.dropna(subset=keys).where(F.col("rows") > F.lit(share * total)).select(*[col(k) for k in keys]).collect() if total else []
    found, taken, salt, held = (f"{n}-{uuid.uuid4().hex}" for n in ("found", "taken", "salt", "held"))  # names that no table has
    away = F.lit(False)
    for k in keys:
        away = away | col(k).isNull()
    marked = rows
    if hot:
        types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        named = rows.sparkSession.createDataFrame([tuple(r) for r in hot], types).join(side, keys, "left")
        weight = named.agg(F.sum(F.length(F.to_json(F.struct(*[col(c) for c in named.columns]))))).first()[0]
        if weight <= hot_bytes:
            ready = named.select(*[col(k) for k in keys], F.struct(*[col(c) for c in other]).alias(held), F.lit(True).alias(taken))
            marked = rows.join(F.broadcast(ready), keys, "left")
            if len(hot) == named_keys:
                return marked.select(*[col(c) for c in rows.columns], *[col(held)[c].alias(c) for c in other])
            away = away | F.coalesce(col(taken), F.lit(False))
    spread = [col(f.name) for f in rows.schema.fields if not _holds_map(f.dataType)]
    marked = marked.withColumn(salt, F.when(away, F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1).otherwise(0))
    nought = F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(1))  # a plain 0 would be taken out of the join's keys
    cold = side.select(*[col(k) for k in keys], F.struct(*[col(c) for c in other]).alias(found), nought.alias(salt))
    met = marked.join(cold, [*keys, salt], "left")
    value = lambda c: F.when(col(taken), col(held)[c]).otherwise(col(found)[c]) if taken in met.columns else col(found)[c]
    return met.select(*[col(c) for c in rows.columns], *[value(c).alias(c) for c in other])
