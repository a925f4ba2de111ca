"""The feedback loop: track inputs, change one thing, accept it on held-out entities, take it back if it hurts."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import grading as K
from tidemark.operators import ranks as R
from tidemark.operators import ridge as M
from tidemark.operators import scoring as S
from tidemark.operators import tracking as Q
from tidemark.operators.reshape import level, monotone
from tidemark.plans.governance import Registry

T, E, G, Y = "decision_time", "entity_id", "grp", "fwd_return"


@dataclass(frozen=True)
class ModelConfig:
    """(K18)"""

    features: tuple[str, ...]
    half_life: float | None = None
    alpha: float = 10.0


@dataclass(frozen=True)
class LoopsConfig:
    """(K18) Refits a finding must persist and a change rests, looks at a change, brakes, the acceptance share, and the
    inputs that are answers on a scale (levels), which may be re-encoded."""

    persist: int = 3
    cooldown: int = 6
    watch: int = 6
    rollback: float = -1.0
    flips: int = 2
    flip_window: int = 12
    floor: float = 0.5
    acceptance_share: float = 0.4
    screen: float = 1.0
    half_lives: tuple = (None, 12.0, 24.0)
    alphas: tuple = (1.0, 10.0, 100.0)
    levels: tuple = ()


@dataclass(frozen=True)
class Event:
    at: datetime
    kind: str
    what: str
    t: float | None = None
    accepted: bool | None = None


def accepts(entity: str, share: float) -> bool:
    """Whether an entity belongs to the acceptance side: fixed by its id."""
    return zlib.crc32(f"accept|{entity}".encode()) % 1000 < share * 1000


def acceptance(share: float, entity: str = E) -> Column:
    """(K11)"""
    return F.crc32(F.concat(F.lit("accept|"), F.col(entity)).cast("binary")) % 1000 < int(share * 1000)


def meaningful(weights: Sequence[float], floor: float = 0.5) -> list[int]:
    """Signs of the weights that aren't small against their median size; 0 for the small."""
    sizes = [abs(w) for w in weights if w]
    least = floor * float(np.median(sizes)) if sizes else 0.0
    return [0 if abs(w) < least else (1 if w > 0 else -1) for w in weights]


def flips(signs: Sequence[int]) -> int:
    """(K12)"""
    s = [x for x in signs if x]
    return sum(a != b for a, b in zip(s, s[1:]))


def goes_back(new: str, older: Sequence[str], alike: float = 0.95) -> bool:
    """Whether a wording returns to one it replaced."""
    return any(difflib.SequenceMatcher(None, new, o).ratio() >= alike for o in older)


@dataclass
class Coordinator:
    """(K7-K13) Sequential over refits on the driver; every step's data work is one pass of plans."""

    rows: DataFrame
    config: ModelConfig
    settings: LoopsConfig = field(default_factory=LoopsConfig)
    walk: M.WalkForward = field(default_factory=lambda: M.WalkForward("month", 10.0, 12))
    registry: Registry | None = None
    timeline: list[tuple[datetime, ModelConfig]] = field(default_factory=list)
    events: list[Event] = field(default_factory=list)
    _grams: dict = field(default_factory=dict)
    _seen: dict = field(default_factory=dict)
    _rest: dict = field(default_factory=dict)
    _signs: dict = field(default_factory=dict)
    _last: tuple | None = None
    _tried: set = field(default_factory=set)
    _bent: dict = field(default_factory=dict)

    def grams(self) -> M.Grams:
        """One pass over the rows serves every configuration. (4.3-E)"""
        if "all" not in self._grams:
            self._features = sorted({f for f in self.config.features} | {f for _, c in self.timeline for f in c.features} | self._tried)
            d = R.centred_ranks(self.rows, self._features, T)
            self._grams["rows"] = d
            self._grams["all"] = M.grams(M.model_rows(d, Y, T, G), self._features, "target", T, "label_end")
        return self._grams["all"]

    def scores(self, c: ModelConfig, until: datetime | None = None) -> DataFrame:
        g = self.grams().keep(c.features)
        w = replace(self.walk, alpha=c.alpha, half_life=c.half_life).weights(g)
        w = {t: v for t, v in w.items() if until is None or t < until}
        return M.apply_weights(self._grams["rows"], list(c.features), T, w)

    def closed(self, at: datetime) -> Column:
        return F.col("label_end") < F.lit(at)

    def paired(self, a: ModelConfig, b: ModelConfig, at: datetime, side: Column) -> tuple[float | None, int]:
        """t over periods of the net book of b less that of a, on one side's entities, in closed periods."""
        book = lambda c: S.rank_weighted(self.scores(c, at).where(self.closed(at) & side)).select(T, "net")
        d = book(a).withColumnRenamed("net", "__a").join(book(b), T).withColumn("d", F.col("net") - F.col("__a"))
        r = S.period_t(d, "d").first()
        return r.t, r.n

    def judge(self, new: ModelConfig, what: str, at: datetime) -> bool:
        """Screened on the diagnosis side, accepted only on the other, against the registry's bar."""
        share = acceptance(self.settings.acceptance_share)
        t, _ = self.paired(self.config, new, at, ~share)
        if t is None or t < self.settings.screen:
            self.events.append(Event(at, "screened out", what, t, False))
            return False
        t, _ = self.paired(self.config, new, at, share)
        bar = self.registry.bar() if self.registry else 1.96
        ok = t is not None and t >= bar
        self.events.append(Event(at, "judged", what, t, ok))
        if ok:
            self._last = (at, self.config)
            self.config = new
            self._rest[what] = 0
        return ok

    def track(self, at: datetime) -> list[str]:
        """Inputs the residuals accuse in so many refits running, and that aren't resting. (K1, K2, K7)"""
        s = self.scores(self.config, at).where(self.closed(at))
        r = K.residual_frame(s, "score", Y, T, G, "label_end", F.lit(at))
        w = self._weights(at)
        found = {x.field: x.verdict for x in K.attribution(r, list(self.config.features), T, w).collect() if x.verdict != "fine"}
        for f in self.config.features:
            self._seen[f] = self._seen.get(f, 0) + 1 if f in found else 0
            self._rest[f] = self._rest.get(f, self.settings.cooldown) + 1
            self._signs.setdefault(f, []).append(0)
        for f, sign in zip(self.config.features, meaningful([w[f] for f in self.config.features], self.settings.floor)):
            self._signs[f][-1] = sign
        return [f for f in found if self._seen[f] >= self.settings.persist and self._rest[f] > self.settings.cooldown]

    def _weights(self, at: datetime) -> dict[str, float]:
        g = self.grams().keep(self.config.features)
        w = replace(self.walk, alpha=self.config.alpha, half_life=self.config.half_life).fit(g, at, sorted(set(g.times)))
        return dict(zip(self.config.features, map(float, w[1:] if w is not None else np.zeros(len(self.config.features)))))

    def oscillating(self) -> list[str]:
        """(K12)"""
        n = self.settings.flip_window
        return [f for f, s in self._signs.items() if flips(s[-n:]) >= self.settings.flips]

    def rollback_if_worse(self, at: datetime) -> bool:
        """The last change goes if the time since tells against it on the acceptance side."""
        if not self._last:
            return False
        since, old = self._last
        side = (F.col(T) >= F.lit(since)) & acceptance(self.settings.acceptance_share)
        t, n = self.paired(old, self.config, at, side)
        if n >= 3 and t is not None and t <= self.settings.rollback:
            self.config, self._last = old, None
            self.events.append(Event(at, "rolled back", "", t, True))
            return True
        if n >= self.settings.watch:
            self._last = None
        return False

    def outer_step(self, at: datetime) -> bool:
        """Half-life and penalty. (K8)"""
        options = [replace(self.config, half_life=h, alpha=a) for h in self.settings.half_lives for a in self.settings.alphas]
        g = self.grams().keep(self.config.features)
        times = [t for t in sorted(set(g.times)) if t < at][-self.settings.watch * 2 :]

        def error(c: ModelConfig) -> float:
            out = []
            for t in times:
                w = replace(self.walk, alpha=c.alpha, half_life=c.half_life).fit(g, t, sorted(set(g.times)))
                if w is not None:
                    m = sum(x for x, u, e in zip(g.mats, g.times, g.ends) if u == t and e is not None and e < at)
                    v = np.concatenate([w, [-1.0]])
                    out.append(float(v @ m @ v) if np.ndim(m) else 0.0)
            return float(np.mean(out)) if out else np.inf

        best = min(options, key=error)
        return best != self.config and self.judge(best, f"half-life {best.half_life}, alpha {best.alpha}", at)

    def inner_step(self, accused: Sequence[str], at: datetime) -> bool:
        """The first accused input that isn't swinging is dropped, if that is accepted; one change a cycle. (K9)"""
        for f in accused:
            if f in self.oscillating() or len(self.config.features) < 2:
                self.events.append(Event(at, "frozen", f))
                continue
            return self.judge(replace(self.config, features=tuple(x for x in self.config.features if x != f)), f"drop {f}", at)
        return False

    def bent(self, at: datetime) -> list[str]:
        """Scale answers whose residuals by level haven't been a line in so many refits running. (K3, K9)"""
        mine = [f for f in self.settings.levels if f in self.config.features]
        if not mine:
            return []
        s = self.scores(self.config, at).where(self.closed(at))
        d = Q.tracking_frame(s, "score", Y, T, G, "label_end", F.lit(at))
        raw = self.rows.select(E, T, *[level(f).alias(f"__level_{f}") for f in mine])
        d = d.join(raw, [E, T])
        for f in mine:
            others = [x for x in self.config.features if x != f]
            shapes = Q.calibration_table(Q.cleaned(d, others, T) if others else d.withColumn("clean", F.col("resid")), "clean", f"__level_{f}", T)
            t = shapes.agg(F.max(F.abs("shape_t"))).first()[0]
            self._bent[f] = self._bent.get(f, 0) + 1 if t is not None and t >= Q.SHAPE_T else 0
        return [f for f in mine if self._bent[f] >= self.settings.persist and self._rest.get(f, self.settings.cooldown + 1) > self.settings.cooldown]

    def reencode(self, bent: Sequence[str], at: datetime) -> bool:
        """The first bent input gets a step for each level instead of a line, if that is accepted. (K9)"""
        for f in bent:
            steps = monotone(f)
            self.rows = self.rows.withColumns({k: c for k, c in steps.items() if k not in self.rows.columns})
            self._tried |= set(steps)
            self._grams.clear()
            self._bent[f] = 0
            if self.judge(replace(self.config, features=(*[x for x in self.config.features if x != f], *steps)), f"steps of {f}", at):
                return True
        return False

    def cycle(self, at: datetime) -> None:
        """(K7)"""
        self.timeline.append((at, self.config))
        self.grams()
        accused = self.track(at)
        if not self.rollback_if_worse(at):
            self.reencode(self.bent(at), at) or self.inner_step(accused, at) or self.outer_step(at)
        self.timeline[-1] = (at, self.config)

    def config_at(self, t: datetime) -> ModelConfig:
        """Half-open: a change holds from its own instant on."""
        had = [c for a, c in self.timeline if a <= t]
        return had[-1] if had else (self.timeline[0][1] if self.timeline else self.config)

    def stitched(self) -> DataFrame:
        """Scores under the configuration in force at each decision."""
        g = self.grams()
        out: dict[ModelConfig, list[datetime]] = {}
        for t in sorted(set(g.times)):
            out.setdefault(self.config_at(t), []).append(t)
        parts = [self.scores(c).where(F.col(T).isin(ts)) for c, ts in out.items()]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole


def replay(rows: DataFrame, config: ModelConfig, refits: Sequence[datetime], **kw) -> dict:
    """The loop on against a frozen twin, paired by period."""
    on = Coordinator(rows, config, **kw)
    for at in refits:
        on.cycle(at)
    frozen = Coordinator(rows, config, **{k: v for k, v in kw.items() if k != "registry"})
    a = S.rank_weighted(on.stitched()).select(T, F.col("net").alias("a"))
    b = S.rank_weighted(frozen.scores(config)).select(T, F.col("net").alias("b"))
    t = S.period_t(a.join(b, T).withColumn("d", F.col("a") - F.col("b")), "d").first()
    if on.registry:
        on.registry.record_internal(sum(e.kind == "judged" for e in on.events), "loop")
    return {"periods": t.n, "mean": t.mean, "t": t.t, "events": on.events, "config": on.config}


@dataclass
class QuestionLoop:
    """Accept a change of the questions only if the score of the whole rises by enough and no gate fails."""

    questions: object
    score: object
    gates: Sequence = ()
    least_gain: float = 0.005
    max_idle: int = 3
    history: list = field(default_factory=list)

    def run(self, proposals: Sequence) -> object:
        best, idle, worded = self.score(self.questions), 0, {q.id: [q.wording] for q in self.questions.questions}
        for q in proposals:
            if idle >= self.max_idle:
                break
            old = worded.setdefault(q.id, [])
            if goes_back(q.wording, old[:-1]):
                self.history.append((q.id, "goes back", None))
                continue
            new = self.questions.with_question(q)
            got = self.score(new)
            ok = got >= best + self.least_gain and all(g(new) for g in self.gates)
            self.history.append((q.id, "accepted" if ok else "rejected", got))
            if ok:
                self.questions, best, idle = new, got, 0
                old.append(q.wording)
            else:
                idle += 1
        return self.questions
