"""A study: panel assembly, judged candidates, reports and cohort tests over one registry."""

from __future__ import annotations

import importlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ranks as R
from tidemark.operators import ridge as M
from tidemark.operators import scoring as S
from tidemark.operators.asof import attach
from tidemark.operators.cohorts import cohort_paths, monthly, overlapping
from tidemark.operators.labels import check_panel
from tidemark.operators.reshape import feature_set, transform, with_candidate
from tidemark.plans.governance import Periods, Registry, Test, in_stage, required_t

T, E, G, Y = "decision_time", "entity_id", "grp", "fwd_return"


@dataclass(frozen=True)
class SourceSpec:
    """(L17) Observations of a source, the features wanted (None: all seen), and how old a value may be."""

    observations: DataFrame
    features: tuple[str, ...] | None = None
    max_age_days: float | None = None


def build_panel(universe: DataFrame, sources: Sequence[SourceSpec], labels: DataFrame | None = None) -> DataFrame:
    """Universe rows with labels, and x_<f>, at_<f> of every feature; one as-of pass a source.

    Two sources of one feature are an error; a feature without rows is a null column; a cell known at or after its
    decision is an error."""
    p, seen = universe, set()
    if labels is not None:
        p = p.join(labels, [E, T], "left")
    for s in sources:
        names = list(s.features) if s.features is not None else [r.feature for r in s.observations.select("feature").distinct().orderBy("feature").collect()]
        if twice := seen & set(names):
            raise ValueError(f"two sources of {sorted(twice)}")
        seen |= set(names)
        p = attach(p, E, T, s.observations, "feature", "value", "available_at", "seq", names, s.max_age_days)
    check_panel(p, T, [f"at_{f}" for f in sorted(seen)], "entry_time" if "entry_time" in p.columns else None)
    return p.withColumnsRenamed({f"x_{f}": f for f in seen})


@dataclass(frozen=True)
class Candidate:
    """(P8)"""

    feature: str
    kind: str = "level"
    scope: str | None = None

    @property
    def name(self) -> str:
        return f"{self.feature}:{self.kind}" + (f"@{self.scope}" if self.scope else "")


@dataclass
class Study:
    """(S18) panel has entity_id, decision_time, grp, features, fwd_return, label_end, rt_cost."""

    panel: DataFrame
    base: list[str]
    periods: Periods
    registry: Registry
    walk: M.WalkForward = field(default_factory=M.WalkForward)
    winsor: tuple[float, float] = (0.01, 0.99)
    overlap: int = 1
    sets: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @classmethod
    def from_config(cls, spark: SparkSession, config: str | Mapping) -> Study:
        """A YAML file or a mapping naming a `market` callable (dotted path) that gives the panel."""
        if isinstance(config, str):
            import yaml

            with open(config) as f:
                config = yaml.safe_load(f)
        module, _, name = config["market"].rpartition(".")
        panel = getattr(importlib.import_module(module), name)(spark, **config.get("params", {}))
        sets = config.get("feature_sets", {})
        base = [g for f in config.get("base", []) for g in (feature_set(f[1:], sets) if f.startswith("@") else [f])]
        return cls(panel, base, Periods(**config["periods"]), Registry(config["registry"], config.get("name", "study")), M.WalkForward(**config.get("walk", {})), sets=sets)

    def rows(self, stage: str, **grants) -> DataFrame:
        return in_stage(self.panel, F.to_date(T), self.periods, stage, **grants)

    def _history(self, stage: str, **grants) -> DataFrame:
        """All rows up to a stage's end, for those who may see the stage: its models learn from what came before."""
        self.rows(stage, **grants)
        return self.panel.where((F.to_date(T) >= F.lit(self.periods.start)) & (F.to_date(T) < F.lit(self.periods.stage(stage)[1])))

    def _inside(self, df: DataFrame, stage: str) -> DataFrame:
        return df.where(F.to_date(T) >= F.lit(self.periods.stage(stage)[0]))

    def scored(self, rows: DataFrame, features: Sequence[str]) -> DataFrame | None:
        """Walk-forward scores of the rows; None without features or history."""
        if not features:
            return None
        d = R.winsorized(rows.where(F.col(Y).isNotNull()), Y, T, *self.winsor)
        d = R.centred_ranks(d, features, T)
        g = M.grams(M.model_rows(d, Y, T, G), features, "target", T, "label_end")
        w = self.walk.weights(g)
        return M.apply_weights(d, features, T, w) if w else None

    def gains(self, rows: DataFrame, features: Sequence[str], extra: str) -> DataFrame:
        """decision_time, gain: rank correlation with the candidate less without, on the same periods."""
        with_ = self.scored(rows, [*features, extra])
        if with_ is None:
            return rows.limit(0).select(T, F.lit(None).cast("double").alias("gain"))
        with_ = S.rank_ic(with_).select(T, F.col("ic").alias("a"))
        base = self.scored(rows, features)
        if base is None:
            return with_.select(T, F.col("a").alias("gain"))
        return with_.join(S.rank_ic(base).select(T, F.col("ic").alias("b")), T).select(T, (F.col("a") - F.col("b")).alias("gain"))

    def power(self, rows: DataFrame, bar: float) -> float | None:
        """Least effect the test could find."""
        got = S.ic_noise(rows.where(F.col(Y).isNotNull()), T).first().sd
        n = rows.select(T).distinct().count()
        return None if got is None or n < 3 else S.mde(got, n, bar, overlap=self.overlap)

    def test(self, c: Candidate, check: bool = True) -> Test:
        """Bar, power, judgement in tuning, then one look at the check period, all recorded."""
        bar = self.registry.bar()
        made = with_candidate(self.panel, c.feature, c.kind, E, T, "__cand", G, c.scope)
        name = f"__cand__{c.scope}" if c.scope else "__cand"
        own = replace(self, panel=made)
        rows = own.rows("tuning")
        t = S.period_t(own.gains(rows, self.base, name), "gain", self.overlap).first()
        kept = t.t is not None and t.t >= bar
        test = self.registry.record(Test(candidate=c.name, stage="tuning", periods=t.n, effect=t.mean, t=t.t, bar=bar, mde=self.power(rows, bar), verdict="kept" if kept else "dropped"))
        if kept and check:
            grant = self.registry.open_check(c.name)
            gains = own._inside(own.gains(own._history("check", grant=grant), self.base, name), "check")
            t = S.period_t(gains, "gain", self.overlap).first()
            ok = t.t is not None and t.t >= grant.bar
            self.registry.record(Test(kind="check", candidate=c.name, stage="check", periods=t.n, effect=t.mean, t=t.t, bar=grant.bar, verdict="confirmed" if ok else "failed"))
        return test

    def discover(self, candidates: Sequence[Candidate]) -> list[Test]:
        """Each candidate once; those tested before are left out."""
        return [self.test(c) for c in candidates if not self.registry.tested(c.name)]

    def report(self, stage: str = "tuning", **grants) -> dict:
        """(D13, A9)"""
        d = self.scored(self._history(stage, **grants), self.base)
        if d is None:
            return {}
        d = S.fill_costs(self._inside(d, stage))
        ic = S.period_t(S.rank_ic(d), "ic", self.overlap).first().asDict()
        spread = S.period_t(S.quantile_spreads(d, 0.1, 3), "net", self.overlap).first().asDict()
        g = S.book_rows(d, "score", Y, "rt_cost", T, E)
        books = {k: S.book_summary(S.portfolio(g, s, T, E)).first().asDict() for k, s in {"band": S.band_signal(0.9, 0.7), "top": S.top_signal(0.9)}.items()}
        return {"ic": ic, "spread": spread, "books": books}

    def report_holdout(self, lock, reason: str) -> dict:
        lock.unlock(reason)
        return self.report("holdout", holdout_open=True)

    def coverage(self) -> dict[str, float]:
        """(A19)"""
        return self.panel.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in self.base]).first().asDict()


@dataclass(frozen=True)
class CohortTest:
    """Composite score, top fraction, buy and hold, against the mean of all names."""

    inputs: tuple[str, ...]
    required: tuple[str, ...] = ()
    fraction: float = 0.1
    hold_days: int = 365
    cost: float = 0.002

    def run(self, panel: DataFrame, returns: DataFrame, ended: DataFrame | None = None) -> DataFrame:
        """month, r, benchmark, excess, cohorts."""
        s = R.composite(panel, list(self.inputs), list(self.required), T)
        picks = R.pick(s, "score", T, [E], fraction=self.fraction)

        def path(members: DataFrame) -> DataFrame:
            m = members.select(F.to_date(T).alias("entry"), E).withColumns({"leave": F.date_add("entry", self.hold_days), "cohort": F.col("entry"), "cin": F.lit(self.cost / 2), "cout": F.lit(self.cost / 2)})
            m = m.join(ended, E, "left") if ended is not None else m.withColumn("ended", F.lit(None).cast("date"))
            p = cohort_paths(m, returns, "cohort", E, "entry", "leave", "day", "r", "cin", "cout", "ended")
            return monthly(overlapping(p, "day", "r"), "day", "r", "cohorts")

        a, b = path(picks), path(s)
        return a.join(b.select("month", F.col("r").alias("benchmark")), "month").withColumn("excess", F.col("r") - F.col("benchmark"))

    def judge(self, panel: DataFrame, returns: DataFrame, registry: Registry, name: str, lags: int = 12) -> Test:
        bar = registry.bar()
        t = S.newey_west_t(self.run(panel, returns), "excess", "month", lags).first()
        return registry.record(Test(candidate=name, periods=t.n, effect=t.mean, t=t.t, bar=bar, verdict="kept" if t.t is not None and t.t >= bar else "dropped"))


def power_at(sd: float, periods: int, tests: int) -> float:
    return S.mde(sd, periods, required_t(tests)) if periods and math.isfinite(sd) else math.inf


Proposer = Callable[[Study], Sequence[Candidate]]
__all__ = ["Candidate", "CohortTest", "Proposer", "SourceSpec", "Study", "build_panel", "power_at", "transform"]
