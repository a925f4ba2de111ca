"""Labels from bars, universes, schedules, and checks that nothing is known too early."""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PointInTimeError(ValueError):
    """Something is known before it could be."""


def forward_returns(decisions: DataFrame, time: str, bars: DataFrame, entity: str, close_at: str, price: str, horizon: int, delisting: float = -0.3, ended: str | None = None, min_history: int = 0) -> DataFrame:
    """decisions with entry_time, label_end, fwd_return, delisted.

    Entry at the first bar closing after the decision, exit `horizon` bars later. A shorter window counts only if the
    series has ended; its return is compounded with `delisting`. Fewer than min_history bars up to the decision: none."""
    w = Window.partitionBy(entity).orderBy(close_at)
    rest = w.rowsBetween(0, horizon)
    b = bars.where(F.col(price).isNotNull()).select(
        entity, close_at, F.col(price).alias("__p0"), F.lead(price, horizon).over(w).alias("__p1"), F.lead(close_at, horizon).over(w).alias("__t1"),
        F.last(price).over(rest).alias("__pl"), F.last(close_at).over(rest).alias("__tl"), F.row_number().over(w).alias("__i"), (F.col(ended) if ended else F.lit(False)).alias("__ended"),
    )
    d = decisions.withColumn("__id", F.struct(*decisions.columns))
    side = b.select(entity, F.unix_micros(close_at).alias("__k"), F.lit(0).alias("__side"), F.struct(*[c for c in b.columns if c != entity]).alias("__bar"))
    pts = d.select(entity, F.unix_micros(time).alias("__k"), F.lit(1).alias("__side"), "__id")
    both = side.unionByName(pts, allowMissingColumns=True)
    back = Window.partitionBy(entity).orderBy(F.col("__k").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("__bar", F.last("__bar", True).over(back)).where(F.col("__id").isNotNull() & (F.col("__bar").isNull() | (F.unix_micros("__bar." + close_at) > F.col("__k"))))
    hit = hit.where(F.col("__bar").isNull() | (F.col("__bar.__i") - 1 >= min_history))
    bar = lambda c: F.col(f"__bar.{c}")
    whole, dead = bar("__p1").isNotNull(), bar("__p1").isNull() & bar("__ended")
    ret = F.when(whole, bar("__p1") / bar("__p0") - 1).when(dead, bar("__pl") / bar("__p0") * (1 + delisting) - 1)
    return hit.select("__id.*", bar(close_at).alias("entry_time"), F.when(whole, bar("__t1")).when(dead, bar("__tl")).alias("label_end"), ret.alias("fwd_return"), F.coalesce(dead, F.lit(False)).alias("delisted"))


def daily_returns(bars: DataFrame, entity: str, close_at: str, price: str, ended: str, delisting: float = -0.3) -> DataFrame:
    """entity, close_at, r; the last bar of an ended series is compounded with the delisting return. (L3)"""
    w = Window.partitionBy(entity).orderBy(close_at)
    r = F.col(price) / F.lag(price).over(w) - 1
    last = F.lead(close_at).over(w).isNull() & F.col(ended)
    return bars.select(entity, close_at, F.when(last, (1 + r) * (1 + delisting) - 1).otherwise(r).alias("r"))


def with_ended(bars: DataFrame, entity: str, close_at: str, days: int) -> DataFrame:
    """bars with ended: the series' last close is more than so many days before the table's."""
    last = F.max(close_at).over(Window.partitionBy(entity))
    end = bars.agg(F.max(close_at).alias("__end"))
    return bars.withColumn("__last", last).join(F.broadcast(end)).withColumn("ended", F.datediff("__end", "__last") > days).drop("__last", "__end")  # one row


def leaks(panel: DataFrame, time: str, cells: Sequence[str]) -> Column:
    """Whether any provenance is at or after the decision."""
    bad = F.lit(False)
    for c in cells:
        bad = bad | F.coalesce(F.col(c) >= F.col(time), F.lit(False))
    return bad


def check_panel(panel: DataFrame, time: str, cells: Sequence[str], entry: str | None = None) -> int:
    """Number of filled cells; raises with up to five examples if a cell or an entry is too early."""
    bad = leaks(panel, time, cells)
    if entry:
        bad = bad | F.coalesce(F.col(entry) <= F.col(time), F.lit(False))
    seen = panel.where(bad).limit(5).collect()
    if seen:
        raise PointInTimeError(f"known too early: {[r.asDict() for r in seen]}")
    filled = [F.sum(F.col(c).isNotNull().cast("long")) for c in cells]
    return int(panel.agg(sum(filled[1:], filled[0]).alias("n")).first().n or 0)


def validate(df: DataFrame, columns: Sequence[str], time: str, key: Sequence[str] = ()) -> DataFrame:
    """df, or an error for a missing column, a time that isn't an instant, a null time, or a repeated key."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}")
    if df.schema[time].dataType.simpleString() != "timestamp":
        raise PointInTimeError(f"{time} must be an instant, not {df.schema[time].dataType.simpleString()}")
    if df.where(F.col(time).isNull()).limit(1).collect():
        raise PointInTimeError(f"null {time}")
    if key and df.groupBy(*key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"repeated {list(key)}")
    return df


def schedule(start: date, end: date, kind: str, every: str, tz: str, close: str, after_minutes: int = 0) -> list[datetime]:
    """Decision instants of a trading (Mon-Fri) or continuous calendar in [start, end): last day of each period, at the
    local close plus a delay, as UTC. (L18)"""
    zone = zoneinfo.ZoneInfo(tz)
    h, m = map(int, close.split(":"))
    days = [start + timedelta(i) for i in range((end - start).days)]
    days = [d for d in days if kind == "continuous" or d.weekday() < 5]
    if every == "daily":
        keep = days
    else:
        mark = {"weekly": lambda d: (d - timedelta(d.weekday())), "monthly": lambda d: (d.year, d.month), "quarterly": lambda d: (d.year, (d.month - 1) // 3)}
        if every not in mark:
            raise ValueError(f"unknown schedule {every}")
        last = {mark[every](d): d for d in days}
        keep = sorted(last.values())
        if every in ("monthly", "quarterly", "weekly") and keep:
            nxt = keep[-1] + timedelta(1)
            while kind != "continuous" and nxt.weekday() > 4:
                nxt += timedelta(1)
            if mark[every](nxt) == mark[every](keep[-1]):
                keep = keep[:-1]
    return [datetime(d.year, d.month, d.day, h, m, tzinfo=zone).astimezone(UTC) + timedelta(minutes=after_minutes) for d in keep]


def schedule_table(spark: SparkSession, times: Sequence[datetime]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in times], "decision_time timestamp")


#: Microseconds of a cell in which bars and decisions meet.
UNIVERSE_CELL = 32 * 86_400_000_000


def universe(schedule_: DataFrame, bars: DataFrame, entity: str, close_at: str, max_stale_days: int, group: str | None = None) -> DataFrame:
    """decision_time, entity, grp of the names whose last bar closed before the decision and isn't stale. (L4)

    Each bar is looked up in the cells of time in which it may be a name's last, so bars and decisions meet by equal cells."""
    until = F.unix_micros("decision_time")
    b = bars.select(entity, F.unix_micros(close_at).alias("__t"), (F.col(group) if group else F.lit("all")).alias("grp"))
    b = b.withColumn("__next", F.coalesce(F.lead("__t").over(Window.partitionBy(entity).orderBy("__t")), F.lit(2**62)))
    live = (F.col("__t") < until) & (until <= F.col("__next")) & (until - F.col("__t") <= max_stale_days * 86_400_000_000)
    cell = lambda c: F.floor(c / F.lit(UNIVERSE_CELL))
    last = F.least(F.col("__next"), F.col("__t") + F.lit(max_stale_days * 86_400_000_000))
    b = b.withColumn("__cell", F.explode(F.sequence(cell(F.col("__t")), cell(last))))
    return b.join(schedule_.withColumn("__cell", cell(until)), "__cell").where(live).select("decision_time", entity, "grp")
