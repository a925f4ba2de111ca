"""Reshaping, transforms and encodings of panel features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], seq: str) -> DataFrame:
    """ids, seq, feature, value; null cells stay, emission order is seq."""
    return df.select(*ids, seq, *[F.col(v).cast("double").alias(v) for v in values]).unpivot([*ids, seq], list(values), "feature", "value")


def widen(df: DataFrame, ids: Sequence[str], feature: str, value: str, names: Sequence[str], seq: str | None = None) -> DataFrame:
    """A column a name: the first value in seq order, or the mean without seq."""
    agg = F.min_by(value, seq) if seq else F.avg(value)
    return df.groupBy(*ids).pivot(feature, list(names)).agg(agg)


def transform(x: str, kind: str, entity: str, order: str) -> Column:
    """level, log (signed log1p), chg<k>, pct<k>: against k rows of the same entity earlier."""
    c = F.col(x)
    if kind == "level":
        return c
    if kind == "log":
        return F.signum(c) * F.log1p(F.abs(c))
    if kind[:3] in ("chg", "pct") and kind[3:].isdigit():
        was = F.lag(x, int(kind[3:])).over(Window.partitionBy(entity).orderBy(order))
        return c - was if kind.startswith("chg") else (c - was) / F.nullif(F.abs(was), F.lit(0.0))
    raise ValueError(f"unknown transform {kind}")


def with_candidate(df: DataFrame, x: str, kind: str, entity: str, order: str, name: str, group: str | None = None, scope: str | None = None) -> DataFrame:
    """df with the transformed column, and for a scope a second one that is null outside the group."""
    df = df.withColumn(name, transform(x, kind, entity, order))
    return df.withColumn(f"{name}__{scope}", F.when(F.col(group) == scope, F.col(name))) if scope else df


def level(x: str) -> Column:
    """A scale answer as a level from 0 to 4, halves to even. (P10)"""
    return F.when(F.col(x).isNotNull(), F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(4.0)))


def one_hot(x: str) -> dict[str, Column]:
    """(P9)"""
    return {f"{x}_eq{k}": F.when(F.col(x).isNotNull(), (level(x) == k).cast("double")) for k in range(5)}


def monotone(x: str) -> dict[str, Column]:
    """(P9)"""
    return {f"{x}_ge{k}": F.when(F.col(x).isNotNull(), (F.col(x) >= k - 0.5).cast("double")) for k in range(1, 5)}


def dummies(x: str, values: Sequence[str]) -> dict[str, Column]:
    """(P12)"""
    return {f"{x}_{v}": F.coalesce((F.col(x) == v).cast("double"), F.lit(0.0)) for v in values}


def feature_set(name: str, sets: Mapping[str, Sequence[str]], seen: tuple = ()) -> list[str]:
    """A named set with its @includes, in order, each feature once."""
    if name in seen:
        raise ValueError(f"feature set {name} includes itself")
    out: list[str] = []
    for f in sets[name]:
        for g in feature_set(f[1:], sets, (*seen, name)) if f.startswith("@") else [f]:
            if g not in out:
                out.append(g)
    return out


def first_range(code: Column, ranges: Sequence[tuple[int, int, str]], default: str | None = None) -> Column:
    """Name of the first inclusive range that holds the code."""
    out = F.lit(default)
    for lo, hi, name in reversed(ranges):
        out = F.when(code.between(lo, hi), name).otherwise(out)
    return out
