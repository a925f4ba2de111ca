"""Tracking of inputs after the fact: attribution, calibration, decay, records and the flags that follow from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ridge as M
from tidemark.operators.asof import asof
from tidemark.operators.grading import spearman
from tidemark.operators.ranks import demean, pct_rank
from tidemark.operators.scoring import correlation

#: Fixed values: |t| from which a slope is flagged, a shape isn't a line, and (below) an input decays.
FLAG_T, SHAPE_T, DECAY_T = 2.0, 2.5, -2.0
#: Digits of what is ranked after means were taken, so that equal values tie whatever the order of their sums.
DIGITS = 10


def tracking_frame(df: DataFrame, score: str, ret: str, period: str, group: str, end: str, cutoff: Column | None = None) -> DataFrame:
    """Scored rows of closed labels with y (rank of the return, less its group's mean) and resid (y less the score). (K1)"""
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull() & F.col(end).isNotNull())
    d = d if cutoff is None else d.where(F.col(end) < cutoff)
    d = d.withColumn("__r", pct_rank(ret, [period]))
    d = d.withColumn("y", F.round(demean("__r", [period, group]), DIGITS)).drop("__r")
    return d.withColumn("resid", F.round(F.col("y") - F.col(score), DIGITS))


def period_t(x: Column) -> Column:
    """t over periods of an aggregate: null for fewer than 3 or without spread."""
    n, s = F.count(x), F.stddev_samp(x)
    return F.when((n >= 3) & (s > 0), F.avg(x) / (F.nullif(s, F.lit(0.0)) / F.sqrt(n)))


def _t(x: np.ndarray) -> float | None:
    x = x[~np.isnan(x)]
    s = x.std(ddof=1) if len(x) >= 3 else 0.0
    return float(x.mean() / (s / np.sqrt(len(x)))) if s > 0 else None


def attribution_table(df: DataFrame, inputs: Sequence[str], period: str, weights: Mapping[str, float]) -> DataFrame:
    """field, weight, slope_one, t_one, slope_joint, t_joint, t_joint_12, t_joint_24, periods, status. (K2)

    df has resid and the inputs as centred ranks. In each period the centred rank of resid is regressed on each input
    alone and on all together (least squares of least norm). Periods with fewer than five rows more than inputs are left
    out. A joint |t| of FLAG_T or more says missing (no weight), under- or over-weighted, by the slope's sign against
    the weight. One pass: a moment matrix a period (a few hundred) is solved on the driver."""
    d = df.withColumn("__y", pct_rank("resid", [period]) - 0.5)
    g = M.grams(d, inputs, "__y", period, period)
    mats = [m for m in g.mats if m[0, 0] >= len(inputs) + 5]
    one, joint = np.full((len(mats), len(inputs)), np.nan), np.full((len(mats), len(inputs)), np.nan)
    for i, m in enumerate(mats):
        c = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
        v = np.diag(c)[:-1]
        one[i] = np.where(v > 1e-12, c[:-1, -1] / np.where(v > 1e-12, v, 1.0), np.nan)
        joint[i] = M.least_squares(m)
    rows = []
    for j, f in enumerate(inputs):
        w, t, mean = float(weights.get(f, 0.0)), _t(joint[:, j]), float(np.nanmean(joint[:, j])) if len(mats) else None
        status = "ok" if t is None or abs(t) < FLAG_T else "missing" if abs(w) < 1e-9 else "under-weighted" if np.sign(mean) == np.sign(w) else "over-weighted"
        rows.append((f, w, float(np.nanmean(one[:, j])) if len(mats) else None, _t(one[:, j]), mean, t, _t(joint[-12:, j]), _t(joint[-24:, j]), len(mats), status))
    return df.sparkSession.createDataFrame(rows, "field string, weight double, slope_one double, t_one double, slope_joint double, t_joint double, t_joint_12 double, t_joint_24 double, periods long, status string")


def cleaned(df: DataFrame, others: Sequence[str], period: str, out: str = "clean") -> DataFrame:
    """df with out: resid less what the other inputs explain of it in the period, jointly. (K3)

    The slopes are a row a period, and broadcast."""
    g = M.grams(df, others, "resid", period, period)
    rows = [(t, [float(v) for v in M.least_squares(m)]) for t, m in zip(g.times, g.mats)]
    b = df.sparkSession.createDataFrame(rows, "__t timestamp, __b array<double>")
    fit = sum((F.col("__b")[i] * F.col(x) for i, x in enumerate(others)), F.lit(0.0))
    return df.join(F.broadcast(b), F.col(period) == F.col("__t"), "left").withColumn(out, F.col("resid") - fit).drop("__t", "__b")


def calibration_table(df: DataFrame, gap: str, level: str, period: str) -> DataFrame:
    """level, n, gap, gap_t, shape_dev, shape_t: mean residual of each answer level over periods, and its deviation
    from the period's line over levels, where there are three or more. (K3)"""
    per = df.where(F.col(level).isNotNull() & F.col(gap).isNotNull()).groupBy(period, F.col(level).alias("level")).agg(F.avg(gap).alias("g"), F.count("*").alias("c"))
    w = Window.partitionBy(period)
    k, y = F.col("level"), F.col("g")
    mk, my = F.avg(k).over(w), F.avg(y).over(w)
    slope = (F.avg(k * y).over(w) - mk * my) / F.nullif(F.avg(k * k).over(w) - mk * mk, F.lit(0.0))
    per = per.withColumn("dev", F.when(F.count("*").over(w) >= 3, y - my - slope * (k - mk)))
    return per.groupBy("level").agg(F.sum("c").alias("n"), F.avg("g").alias("gap"), period_t(F.col("g")).alias("gap_t"), F.avg("dev").alias("shape_dev"), period_t(F.col("dev")).alias("shape_t"))


def rolling_ic(df: DataFrame, inputs: Sequence[str], y: str, period: str, recent: int = 24) -> DataFrame:
    """field, ic, ic_t, ic_12, ic_24, decay_t, decaying: rank correlation of each input with y, late against early. (K4)

    decay_t needs 6 periods on both sides, and is signed by the early mean. All inputs in one pass."""
    long = df.select(period, y, *inputs).unpivot([period, y], list(inputs), "field", "x")
    ic = spearman(long, "x", y, [period, "field"]).where("rho is not null")
    k = F.row_number().over(Window.partitionBy("field").orderBy(F.col(period).desc()))
    ic = ic.withColumn("k", k)
    late, early = F.when(F.col("k") <= recent, F.col("rho")), F.when(F.col("k") > recent, F.col("rho"))
    var = F.var_samp(late) / F.count(late) + F.var_samp(early) / F.count(early)
    decay = F.when((F.count(late) >= 6) & (F.count(early) >= 6) & (var > 0), F.signum(F.avg(early)) * (F.avg(late) - F.avg(early)) / F.sqrt(var))
    first = lambda n: F.avg(F.when(F.col("k") <= n, F.col("rho")))
    got = ic.groupBy("field").agg(F.avg("rho").alias("ic"), period_t(F.col("rho")).alias("ic_t"), first(12).alias("ic_12"), first(24).alias("ic_24"), decay.alias("decay_t"))
    return got.withColumn("decaying", F.coalesce(F.col("decay_t") <= DECAY_T, F.lit(False)))


def tracking_flags(attribution: DataFrame, ics: DataFrame, shapes: DataFrame, questions: Mapping[str, str], misread: Sequence[str] = ()) -> DataFrame:
    """A row a field: status, t_joint, t_one, decaying, decay_t, max_shape_t, non_linear, text, question, misread.

    shapes: field, shape_t of each level; questions: the question of each field that is a reading."""
    top = shapes.groupBy("field").agg(F.max(F.abs("shape_t")).alias("max_shape_t"))
    q = F.create_map(*[F.lit(x) for kv in questions.items() for x in kv])[F.col("field")] if questions else F.lit(None).cast("string")
    got = attribution.select("field", "status", "t_joint", "t_one").join(ics.select("field", "decaying", "decay_t"), "field").join(top, "field", "left")
    got = got.withColumn("non_linear", F.coalesce(F.col("max_shape_t") >= SHAPE_T, F.lit(False))).withColumn("question", q)
    return got.withColumn("text", F.col("question").isNotNull()).withColumn("misread", F.coalesce(F.col("question").isin(*misread), F.lit(False)) if misread else F.lit(False))


def ic_table(df: DataFrame, inputs: Sequence[str], ret: str, period: str, group: str, end: str) -> DataFrame:
    """period, field, ic, ended: rank correlation with the group-adjusted return. (D3)

    Each column is ranked over its own values before pairing; ended is the last label end of the period's rows; rows
    that never have a label don't keep it open. Without spread on a side ic is null."""
    d = df.withColumn("__adj", F.round(demean(ret, [period, group]), DIGITS))
    w = Window.partitionBy(period)
    d = d.select(period, F.max(end).over(w).alias("ended"), pct_rank("__adj", [period]).alias("__y"), *[pct_rank(x, [period]).alias(x) for x in inputs])
    long = d.unpivot([period, "ended", "__y"], list(inputs), "field", "x").where(F.col("x").isNotNull() & F.col("__y").isNotNull())
    return long.groupBy(period, "field", "ended").agg(correlation("x", "__y").alias("ic"))


def input_record(table: DataFrame, cutoff: Column, least: int = 12) -> DataFrame:
    """field, ic, t, periods from the periods closed before the cutoff, where there are `least` of them. (D3)"""
    d = table.where((F.col("ended") < cutoff) & F.col("ic").isNotNull())
    return d.groupBy("field").agg(F.avg("ic").alias("ic"), period_t(F.col("ic")).alias("t"), F.count("*").alias("periods")).where(F.col("periods") >= least)


def question_status(record: DataFrame, questions: Mapping[str, str], keep_t: float = 1.0, enough: int = 24) -> DataFrame:
    """question, best_field, ic, t, status of each question by its strongest field: keep with little history or a |t| of keep_t."""
    q = F.create_map(*[F.lit(x) for kv in questions.items() for x in kv])[F.col("field")]
    d = record.withColumn("question", q).where(F.col("question").isNotNull())
    best = d.groupBy("question").agg(F.max_by(F.struct("field", "ic", "t", "periods"), F.struct(F.coalesce(F.abs("t"), F.lit(-1.0)), "field")).alias("b"))
    keep = (F.col("b.periods") < enough) | (F.coalesce(F.abs("b.t"), F.lit(0.0)) >= keep_t)
    return best.select("question", F.col("b.field").alias("best_field"), F.col("b.ic").alias("ic"), F.col("b.t").alias("t"), F.when(keep, "keep").otherwise("drop").alias("status"))


def last_used(df: DataFrame, at: str, keys: Sequence[str], lag_days: float, seq: str) -> DataFrame:
    """df with last: the latest event of the keys whose outcome, lag_days later, was over before the row's own time."""
    known = df.select(*keys, F.timestamp_micros(F.unix_micros(at) + F.lit(int(lag_days * 86_400_000_000))).alias("__known"), F.col(at).alias("last"), F.col(seq).alias("__seq"))
    return asof(df, at, known, "__known", list(keys), "__seq", ["last"], provenance="__at").drop("__at")


def base_rate_leaks(df: DataFrame, at: str, last: str, lag_days: float, by: Sequence[str] = ()) -> DataFrame:
    """by, events, leaks, min_gap (microseconds), passed: rows whose base rate used an outcome not over before their time."""
    gap = F.unix_micros(at) - F.unix_micros(last)
    bad = F.sum(F.coalesce(gap <= int(lag_days * 86_400_000_000), F.lit(False)).cast("long"))
    return df.groupBy(*by).agg(F.count("*").alias("events"), bad.alias("leaks"), F.min(gap).alias("min_gap"), (bad == 0).alias("passed"))
