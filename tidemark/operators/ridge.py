"""Walk-forward ridge by sufficient statistics: one pass over the rows serves every refit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import demean, pct_rank
from tidemark.operators.scoring import correlation


@dataclass
class Grams:
    """Moment matrices of (1, x..., y) a (decision time, label end): a few hundred small matrices, whatever the rows."""

    features: list[str]
    times: list[datetime]
    ends: list[datetime | None]
    mats: np.ndarray
    scale: dict = field(default_factory=dict)

    def keep(self, features: Sequence[str]) -> Grams:
        """The same statistics of fewer features, without another pass."""
        at = [0, *[1 + self.features.index(f) for f in features], len(self.features) + 1]
        return Grams(list(features), self.times, self.ends, self.mats[:, at][:, :, at])


def grams(df: DataFrame, features: Sequence[str], y: str, time: str, end: str) -> Grams:
    """(4.3-E) Sums are combined before the shuffle; rows without y or features are left out."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    ok = F.col(y).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    rows = df.where(ok).groupBy(time, end).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{k}") for k, (i, j) in enumerate(pairs)]).orderBy(time, end).collect()
    mats = np.zeros((len(rows), len(cols), len(cols)))
    for n, row in enumerate(rows):
        for k, (i, j) in enumerate(pairs):
            mats[n, i, j] = mats[n, j, i] = row[f"g{k}"]
    return Grams(list(features), [r[time] for r in rows], [r[end] for r in rows], mats)


def solve(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of ||y - Xb - c||^2 + alpha ||b||^2; the intercept isn't penalised. (M1)"""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    c = gram[1:, 1:] - n * np.outer(mean, mean)
    k = len(mean) - 1
    b = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k]) if k else np.zeros(0)
    return np.concatenate([[mean[k] - mean[:k] @ b], b])


def least_squares(gram: np.ndarray) -> np.ndarray:
    """Slopes of least norm, for inputs that may be collinear. (K2)"""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    c = gram[1:, 1:] - n * np.outer(mean, mean)
    k = len(mean) - 1
    return np.linalg.pinv(c[:k, :k], rcond=1e-10) @ c[:k, k]


@dataclass(frozen=True)
class WalkForward:
    """(M3, M4) Blocks are calendar years, quarters or months; a block is scored by what had closed before it."""

    block: str = "year"
    alpha: float = 10.0
    min_periods: int = 12
    embargo_days: int = 0
    half_life: float | None = None

    def block_of(self, t: datetime) -> tuple:
        return {"year": (t.year,), "quarter": (t.year, (t.month - 1) // 3), "month": (t.year, t.month)}[self.block]

    def weights(self, g: Grams) -> dict[datetime, np.ndarray]:
        """Coefficients in force at each decision time; times of blocks with too little history are left out."""
        out: dict[datetime, np.ndarray] = {}
        times = sorted(set(g.times))
        for b in sorted({self.block_of(t) for t in times}):
            inside = [t for t in times if self.block_of(t) == b]
            w = self.fit(g, inside[0], times)
            if w is not None:
                out |= dict.fromkeys(inside, w)
        return out

    def fit(self, g: Grams, first: datetime, times: list[datetime]) -> np.ndarray | None:
        gap = timedelta(days=self.embargo_days)
        use = [k for k, e in enumerate(g.ends) if e is not None and e + gap < first]
        if len({g.times[k] for k in use}) < self.min_periods:
            return None
        age = {t: i for i, t in enumerate(reversed([t for t in times if t < first]))}
        w = [0.5 ** (age[g.times[k]] / self.half_life) if self.half_life else 1.0 for k in use]
        return solve(np.tensordot(w, g.mats[use], axes=1), self.alpha)

    def best_half_life(self, g: Grams, first: datetime, grid: Sequence[float], rows: DataFrame, y: str, time: str, before: float | None = None, periods: int = 12) -> float | None:
        """Half-life of the best mean rank correlation over the last closed periods, at most a step from the last choice. (M5)

        Each candidate is fitted anew for each period on what had closed before it; ties go to the earlier candidate; with
        too little history there is none. All candidates are scored in one pass over the rows of those periods."""
        times = sorted(set(g.times))
        closed = [t for t in times if all(e is not None and e < first for x, e in zip(g.times, g.ends) if x == t)]
        if len(closed) < self.min_periods + periods:
            return None
        options = list(grid)
        if before in options:
            i = options.index(before)
            options = options[max(0, i - 1) : i + 2]
        fits = [(t, j, w) for j, h in enumerate(options) for t in closed[-periods:] if (w := WalkForward(self.block, self.alpha, self.min_periods, self.embargo_days, h).fit(g, t, times)) is not None]
        if not fits:
            return None
        table = rows.sparkSession.createDataFrame([(t, j, [float(v) for v in w]) for t, j, w in fits], "__t timestamp, __j int, __w array<double>")
        d = rows.where(F.col(y).isNotNull()).join(F.broadcast(table), F.col(time) == F.col("__t"))  # periods times candidates
        d = d.withColumn("__p", sum((F.col("__w")[i + 1] * F.col(f) for i, f in enumerate(g.features)), F.col("__w")[0]))
        d = d.select(time, "__j", pct_rank("__p", [time, "__j"]).alias("__a"), pct_rank(y, [time, "__j"]).alias("__b"))
        got = d.groupBy("__j", time).agg(correlation("__a", "__b").alias("r")).groupBy("__j").agg(F.avg("r").alias("r")).collect()
        mean = {r["__j"]: r.r for r in got if r.r is not None}
        return options[max(mean, key=lambda j: (mean[j], -j))] if mean else None


def apply_weights(df: DataFrame, features: Sequence[str], time: str, weights: Mapping[datetime, np.ndarray], contributions: bool = False) -> DataFrame:
    """df with score (and c_<f>: weight times input) of the weights in force; rows of other times are left out. (M3, M6)

    The weights are a row a decision time, and broadcast."""
    spark = df.sparkSession
    rows = [(t, *[float(v) for v in w]) for t, w in weights.items()]
    w = spark.createDataFrame(rows, f"__t timestamp, __w double{''.join(f', __w_{i} double' for i in range(len(features)))}")
    d = df.join(F.broadcast(w), F.col(time) == F.col("__t"))
    parts = [F.col(f"__w_{i}") * F.col(f) for i, f in enumerate(features)]
    d = d.withColumn("score", sum(parts, F.col("__w")))
    if contributions:
        d = d.withColumns({f"c_{f}": p for f, p in zip(features, parts)})
    return d.drop("__t", "__w", *[f"__w_{i}" for i in range(len(features))])


def model_rows(df: DataFrame, y: str, time: str, group: str) -> DataFrame:
    """Labelled rows with target: the label's deviation from its group's mean in the period."""
    return df.where(F.col(y).isNotNull()).withColumn("target", demean(y, [time, group]))


def out_of_fold(g: Grams, fold_of, alpha: float = 10.0) -> dict:
    """Coefficients for each fold, fitted on all others: the whole less the fold's part. (M7)"""
    total = g.mats.sum(0)
    folds = sorted({fold_of(t) for t in g.times})
    return {f: solve(total - sum(m for m, t in zip(g.mats, g.times) if fold_of(t) == f), alpha) for f in folds}
