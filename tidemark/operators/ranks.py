"""Ranks within periods and groups: average ties, missing stays missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import equal_keys, exact_quantiles


def pct_rank(x: str, by: Sequence[str]) -> Column:
    """Average-tie percentile rank in (0, 1] of the non-null x within `by`; null where x is null."""
    part = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    rank = F.rank().over(part.orderBy(F.col(x).asc_nulls_last()))
    return F.when(F.col(x).isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(part))


def centred_ranks(df: DataFrame, xs: Sequence[str], period: str) -> DataFrame:
    """Each x as its rank within the period less one half; a missing x stands at 0. (R2)"""
    return df.withColumns({x: F.coalesce(pct_rank(x, [period]), F.lit(0.5)) - 0.5 for x in xs})


def demean(x: str, by: Sequence[str]) -> Column:
    """x less its mean over `by`."""
    return F.col(x) - F.avg(x).over(Window.partitionBy(*by))


def winsorized(df: DataFrame, x: str, by: str, low: float, high: float) -> Column | DataFrame:
    """df with x clipped to its exact quantiles within `by`; null stays null."""
    q = exact_quantiles(df, x, [by], [low, high], "__q")
    x_ = F.col(x)
    return df.alias("__d").join(q.alias("__k"), equal_keys("__d", "__k", [by]), "left").select("__d.*", "__q").withColumn(x, F.when(x_.isNotNull(), F.greatest(F.least(x_, F.col("__q")[1]), F.col("__q")[0]))).drop("__q")


def rank_target(df: DataFrame, x: str, period: str, group: str | None = None) -> DataFrame:
    """df with target: rank of x within period (and group) less one half. (P5)"""
    return df.withColumn("target", pct_rank(x, [period] + ([group] if group else [])) - 0.5)


def descending_average_rank(x: str, by: Sequence[str]) -> Column:
    """Average-tie rank from 1, largest first."""
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(F.col(x).desc_nulls_last())) + (ties - 1) / F.lit(2.0))


def deciles(order: Sequence[Column], by: Sequence[str]) -> Column:
    """Ten buckets, 0 to 9, over first-occurrence ranks with right-closed linear edges; every row counts."""
    n = F.count("*").over(Window.partitionBy(*by))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((rn - 1) * 10 / F.greatest(n - 1, F.lit(1))).cast("int") - 1)).cast("int")


def composite(df: DataFrame, inputs: Sequence[str], required: Sequence[str], period: str, missing: float = 0.5) -> DataFrame:
    """score: mean rank of the inputs among rows that have all required ones; another missing input counts `missing`."""
    for r in required:
        df = df.where(F.col(r).isNotNull())
    parts = [F.coalesce(pct_rank(x, [period]), F.lit(missing)) for x in inputs]
    return df.withColumn("score", sum(parts[1:], parts[0]) / F.lit(float(len(parts))))


def pick(df: DataFrame, score: str, period: str, ties: Sequence[str], count: int | None = None, fraction: float | None = None, top: bool = True) -> DataFrame:
    """The first `count` rows of each period, or round-half-even(fraction * n) of them and one at least."""
    df = df.where(F.col(score).isNotNull())
    order = (F.col(score).desc() if top else F.col(score).asc(), *[F.col(t).asc() for t in ties])
    n = F.lit(count) if count is not None else F.greatest(F.lit(1), F.rint(F.lit(fraction) * F.count("*").over(Window.partitionBy(period))).cast("int"))
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(period).orderBy(*order))).withColumn("__n", n).where(F.col("__rn") <= F.col("__n")).drop("__rn", "__n")
