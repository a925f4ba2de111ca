"""Buy-and-hold cohorts: daily paths in closed form, overlap, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohort_paths(members: DataFrame, returns: DataFrame, cohort: str, name: str, entry: str, exit_: str, day: str, r: str, cost_in: str, cost_out: str, ended: str | None = None) -> DataFrame:
    """cohort, day, r of equal-weight cohorts held from the day after entry to exit, inclusive.

    A missing bar is a return of 0. The value of a member that ended passes to the others pro rata, which leaves the
    weights among the living as they are, so a day's factor is the sum of the living's values over the same members'
    sum a day before. The first day bears the cost of entry, the last that of exit; with nobody alive it is cash.
    members: one row a cohort and name, with its dates, costs (as shares), and the day it ended or null."""
    m = members.select(cohort, name, entry, exit_, cost_in, cost_out, (F.col(ended) if ended else F.lit(None).cast("date")).alias("__end"))
    m = m.where(F.col("__end").isNull() | (F.col("__end") > F.col(entry)))
    days = returns.select(day).distinct()
    spans = m.groupBy(cohort).agg(F.first(entry).alias("__a"), F.first(exit_).alias("__b"), F.count("*").alias("__n"))
    grid = spans.join(F.broadcast(days), (F.col(day) > F.col("__a")) & (F.col(day) <= F.col("__b"))).select(cohort, day, "__n")  # trading days, a few thousand
    g = grid.join(m, cohort).where(F.col("__end").isNull() | (F.col(day) <= F.col("__end"))).join(returns.select(name, day, F.col(r).alias("__r")), [name, day], "left")
    w = Window.partitionBy(cohort, name).orderBy(day)
    so_far, step = w.rowsBetween(Window.unboundedPreceding, 0), 1 + F.coalesce("__r", F.lit(0.0))
    logs = F.sum(F.when(step != 0, F.ln(F.abs(F.nullif(step, F.lit(0.0)))))).over(so_far)  # a running product
    gone, turned = F.max((step == 0).cast("int")).over(so_far), F.sum((step < 0).cast("int")).over(so_far)
    path = F.when(gone == 1, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))) * F.when(turned % 2 == 1, -1.0).otherwise(1.0))
    g = g.withColumn("__u", (1 - F.col(cost_in)) * path)
    g = g.withColumn("__u0", F.coalesce(F.lag("__u").over(w), F.lit(1.0))).withColumn("__out", F.when(F.col(day) == F.col(exit_), F.col("__u") * F.col(cost_out)).otherwise(0.0))
    return grid.select(cohort, day).distinct().join(g.groupBy(cohort, day).agg((F.sum(F.col("__u") - F.col("__out")) / F.nullif(F.sum("__u0"), F.lit(0.0)) - 1).alias("r")), [cohort, day], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))


def overlapping(paths: DataFrame, day: str, r: str) -> DataFrame:
    """day, r, cohorts: mean over the cohorts alive."""
    return paths.groupBy(day).agg(F.avg(r).alias("r"), F.count("*").alias("cohorts"))


def monthly(series: DataFrame, day: str, r: str, count: str) -> DataFrame:
    """month, r compounded, least number of cohorts."""
    return series.groupBy(F.trunc(day, "month").alias("month")).agg((F.product(1 + F.col(r)) - 1).alias("r"), F.min(count).alias("cohorts"))
