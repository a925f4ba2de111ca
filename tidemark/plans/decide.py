"""Deciders over small batches: cards, picks, records of what was closed, and what overrides earned."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grading import batches, cards, grade_picks
from tidemark.plans.governance import Ledger, Registry, Spend, Test

T, E, G, Y = "decision_time", "entity_id", "grp", "fwd_return"


class Decider(Protocol):
    """Picks one card of a batch, with a reason; paid deciders plug in here."""

    name: str

    def pick(self, batch: Sequence[dict], note: str) -> tuple[int, str]: ...


class NoDecider:
    """The model's own pick: the highest score, the first on a tie."""

    name = "none"

    def pick(self, batch: Sequence[dict], note: str) -> tuple[int, str]:
        return max(range(len(batch)), key=lambda i: (batch[i]["score"], -i)), "model"


@dataclass
class Sizer:
    """Counts what a paid decider would read."""

    name: str = "sizer"
    chars: int = 0

    def pick(self, batch: Sequence[dict], note: str) -> tuple[int, str]:
        self.chars += len(note) + sum(len(b["card"]) for b in batch)
        return NoDecider().pick(batch, note)


def prepare(scored: DataFrame, inputs: Sequence[str], n: int, seed: int = 0, top: int = 3) -> DataFrame:
    """entity_id, decision_time, grp, batch, score, card, fwd_return, label_end: complete batches."""
    d = scored.where("score is not null").withColumn("card", cards(scored, inputs, top))
    return batches(d, [T, G], E, n, seed).select(E, T, G, "batch", "score", "card", Y, "label_end")


def feedback(closed: Sequence[dict]) -> str:
    """A note on overrides whose labels have all ended."""
    over = [r for r in closed if r["override"] and r["edge"] is not None]
    if len(over) < 3:
        return "Too few closed overrides to tell."
    mean = sum(r["edge"] for r in over) / len(over)
    return f"{len(over)} closed overrides earned {mean:+.4f} against the model's pick on average."


@dataclass
class Session:
    """Runs batches in time order, since a note may hold only what had closed by then."""

    decider: Decider
    ledger: Ledger | None = None
    price: Callable[[Sequence[dict]], float] = lambda b: 0.0
    records: list[dict] = field(default_factory=list)

    def run(self, prepared: DataFrame) -> list[dict]:
        """Batches of one period at a time; the driver holds a period's batches, not the table."""
        times = [r[T] for r in prepared.select(T).distinct().orderBy(T).collect()]
        for t in times:
            rows = [r.asDict() for r in prepared.where(F.col(T) == F.lit(t)).orderBy(G, "batch", E).collect()]
            note = feedback([r for r in self.records if r["closed"] is not None and r["closed"] < t])
            groups: dict[tuple, list[dict]] = {}
            for r in rows:
                groups.setdefault((r[G], r["batch"]), []).append(r)
            for key, batch in groups.items():
                usd = self.price(batch)
                if self.ledger and usd:
                    self.ledger.guard("decide", self.decider.name, usd)
                model = NoDecider().pick(batch, "")[0]
                k, why = self.decider.pick(batch, note)
                if self.ledger and usd:
                    self.ledger.record(Spend(step="decide", provider=self.decider.name, usd=usd))
                known = all(b[Y] is not None for b in batch)
                ends = [b["label_end"] for b in batch]
                self.records.append({
                    T: t, G: key[0], "batch": key[1], E: batch[k][E], "override": k != model, "why": why,
                    "edge": batch[k][Y] - batch[model][Y] if known else None, "closed": max(ends) if known and all(ends) else None,
                })
        return self.records


def grade(prepared: DataFrame, records: Sequence[dict]) -> dict:
    """(D8)"""
    spark = prepared.sparkSession
    p = spark.createDataFrame([(r[E], r[T]) for r in records], f"{E} string, {T} timestamp").withColumn("picked", F.lit(True))
    d = prepared.join(p, [E, T], "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    return grade_picks(d, "picked", Y, T).first().asDict()


def log_decider(registry: Registry, name: str, result: dict) -> Test:
    """(D10)"""
    bar = registry.bar()
    return registry.record(Test(candidate=f"decider:{name}", periods=result["periods"], effect=result["edge"], t=result["t"], bar=bar, verdict="kept" if (result["t"] or 0) >= bar else "dropped"))
