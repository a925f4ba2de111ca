"""Registry of judged tests with a rising bar, holdout lock, spend ledger, and caches by fingerprint."""

from __future__ import annotations

import csv
import fcntl
import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from datetime import UTC, date, datetime
from pathlib import Path
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required_t(tests: int, alpha: float = 0.05) -> float:
    """Bonferroni bar of the next of so many tests."""
    return NormalDist().inv_cdf(1 - alpha / 2 / max(1, tests))


@dataclass
class Test:
    """One judged test."""

    id: str = ""
    at: str = ""
    market: str = ""
    kind: str = "test"
    candidate: str = ""
    stage: str = "tuning"
    periods: int = 0
    effect: float | None = None
    t: float | None = None
    bar: float | None = None
    mde: float | None = None
    verdict: str = ""
    count: int = 1
    note: str = ""


@contextmanager
def locked(path: Path):
    """Exclusive across processes; the writer replaces the file in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def _replace(path: Path, rows: Sequence[dict], names: Sequence[str]) -> None:
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w", newline="") as f:
        w = csv.DictWriter(f, names)
        w.writeheader()
        w.writerows(rows)
    os.replace(tmp, path)


@dataclass(frozen=True)
class CheckGrant:
    """Permission to look at the check period once."""

    candidate: str
    bar: float


class Registry:
    """Append-only CSV of tests; inherited registries count towards the bar."""

    NAMES = [f.name for f in fields(Test)]
    CHECK_LIMIT = 30

    def __init__(self, path: str | Path, market: str, inherited: Sequence[str | Path] = ()):
        self.path, self.market, self.inherited = Path(path), market, [Path(p) for p in inherited]

    @staticmethod
    def _read(path: Path) -> list[dict]:
        if not path.exists():
            return []
        with open(path, newline="") as f:
            return list(csv.DictReader(f))

    def rows(self, own: bool = False) -> list[dict]:
        return [r for p in ([self.path] if own else [*self.inherited, self.path]) for r in self._read(p)]

    def judged(self) -> list[dict]:
        """Tests with a numeric t, and what the loop tried within."""

        def numeric(x: str) -> bool:
            try:
                return float(x) == float(x)
            except ValueError:
                return False

        return [r for r in self.rows() if r["kind"] == "loop_internal" or (r["kind"] == "test" and numeric(r["t"]))]

    def n_judged(self) -> int:
        return sum(int(r["count"] or 1) for r in self.judged())

    def bar(self) -> float:
        return required_t(self.n_judged() + 1)

    def tested(self, candidate: str) -> bool:
        return any(r["candidate"] == candidate for r in self.rows())

    def check_uses(self) -> int:
        return sum(r["stage"] == "check" for r in self.rows())

    def record(self, test: Test) -> Test:
        with locked(self.path):
            rows = self._read(self.path)
            test.id, test.market = f"{self.market}-{len(rows) + 1:04d}", self.market
            test.at = test.at or datetime.now(UTC).isoformat(timespec="seconds")
            _replace(self.path, [*rows, {k: "" if v is None else v for k, v in asdict(test).items()}], self.NAMES)
        return test

    def record_internal(self, count: int, note: str = "") -> Test | None:
        return self.record(Test(kind="loop_internal", count=count, note=note)) if count > 0 else None

    def open_check(self, candidate: str) -> CheckGrant:
        if self.check_uses() >= self.CHECK_LIMIT:
            raise PermissionError("the check period has been used up")
        return CheckGrant(candidate, required_t(self.check_uses() + 1))

    def summary(self) -> dict:
        rows = self.rows()
        return {"rows": len(rows), "judged": self.n_judged(), "checks": self.check_uses(), "bar": self.bar(), "kept": sum(r["verdict"] == "kept" for r in rows)}


class HoldoutLock:
    """The holdout opens with a reason, logged before a row is read."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def unlock(self, reason: str, who: str = "") -> dict:
        if not reason.strip():
            raise PermissionError("give a reason")
        entry = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "who": who, "reason": reason.strip()}
        with locked(self.path), open(self.path, "a") as f:
            f.write(json.dumps(entry) + "\n")
        return entry

    def log(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []


@dataclass(frozen=True)
class Periods:
    """Half-open stages of local decision dates."""

    start: date
    check: date
    holdout: date
    end: date

    def stage(self, name: str) -> tuple[date, date]:
        return {"tuning": (self.start, self.check), "check": (self.check, self.holdout), "holdout": (self.holdout, self.end)}[name]


def in_stage(df: DataFrame, local_date, periods: Periods, stage: str, grant: CheckGrant | None = None, holdout_open: bool = False) -> DataFrame:
    """Rows of a stage; the check needs a grant, the holdout an open lock."""
    if stage == "check" and grant is None:
        raise PermissionError("the check stage needs a grant")
    if stage == "holdout" and not holdout_open:
        raise PermissionError("the holdout is locked")
    a, b = periods.stage(stage)
    return df.where((local_date >= F.lit(a)) & (local_date < F.lit(b)))


@dataclass
class Spend:
    at: str = ""
    step: str = ""
    provider: str = ""
    model: str = ""
    units_in: int = 0
    units_out: int = 0
    usd: float = 0.0
    note: str = ""


class OverBudget(RuntimeError):
    pass


class Ledger:
    """What was paid, by step and provider; a call is refused before it would exceed a cap."""

    NAMES = [f.name for f in fields(Spend)]

    def __init__(self, path: str | Path, caps: dict[str, float], funds: dict[str, float], prices: dict[str, tuple[float, float]]):
        self.path, self.caps, self.funds, self.prices = Path(path), caps, funds, prices

    def price(self, model: str, units_in: int, units_out: int) -> float:
        a, b = self.prices[model]
        return (a * units_in + b * units_out) / 1e6

    def rows(self) -> list[dict]:
        return Registry._read(self.path)

    def spent(self, **by: str) -> float:
        return sum(float(r["usd"]) for r in self.rows() if all(r[k] == v for k, v in by.items()))

    def guard(self, step: str, provider: str, usd: float) -> None:
        if step not in self.caps:
            raise OverBudget(f"no cap for step {step}")
        if self.spent(step=step) + usd > self.caps[step]:
            raise OverBudget(f"step {step} would exceed {self.caps[step]}")
        if self.spent(provider=provider) + usd > self.funds.get(provider, 0.0):
            raise OverBudget(f"funds of {provider} would not suffice")

    def record(self, s: Spend) -> None:
        with locked(self.path):
            s.at = s.at or datetime.now(UTC).isoformat(timespec="seconds")
            _replace(self.path, [*self.rows(), asdict(s)], self.NAMES)

    def report(self) -> dict[str, dict]:
        steps = {*self.caps, *[r["step"] for r in self.rows()]}
        return {s: {"cap": self.caps.get(s), "spent": self.spent(step=s)} for s in sorted(steps)}


def fingerprint(*parts) -> str:
    """(S20)"""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached(folder: str, key: str, make: Callable[[], DataFrame], spark) -> DataFrame:
    """The table under its key in a shared folder, made and written the first time."""
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bar_counts(registry: DataFrame) -> DataFrame:
    """market, judged, checks, kept of a registry table."""
    judged = (F.col("kind") == "loop_internal") | ((F.col("kind") == "test") & F.col("t").try_cast("double").isNotNull())
    return registry.groupBy("market").agg(
        F.sum(F.when(judged, F.col("count")).otherwise(0)).alias("judged"), F.count(F.when(F.col("stage") == "check", 1)).alias("checks"), F.count(F.when(F.col("verdict") == "kept", 1)).alias("kept")
    )


def spend_by(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """step, cap, spent, of every step with a cap or a row."""
    return ledger.groupBy("step").agg(F.sum("usd").alias("spent")).join(caps, "step", "full").select("step", F.col("cap").cast("double").alias("cap"), F.coalesce("spent", F.lit(0.0)).alias("spent"))
