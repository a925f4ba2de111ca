"""Bars: cleaning, spread estimators, snapshots and universe rules."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import rolling_median


def positive_bars(bars: DataFrame, price: str, volume: str) -> DataFrame:
    """Without prices of 0 or less and days without trade."""
    return bars.where((F.col(price) > 0) & (F.col(volume) > 0))


def good_prints(prices: list[float], jump: float = 3.0) -> list[bool]:
    """Whether each print stays: one that jumps by a factor and comes back with the next good print goes."""
    keep = [True] * len(prices)
    last = None
    for i, p in enumerate(prices):
        if last is not None and i + 1 < len(prices):
            far = max(p / last, last / p) >= jump
            back = max(prices[i + 1] / last, last / prices[i + 1]) < jump
            if far and back:
                keep[i] = False
                continue
        last = p
    return keep


def drop_bad_prints(bars: DataFrame, entity: str, order: str, price: str, jump: float = 3.0) -> DataFrame:
    """Series are read from sorted partitions, one in memory at a time."""
    kind = bars.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            tail = (b[entity] == b[entity].iloc[-1]).values
            cut = int(tail.argmax())
            rest, b = b.iloc[cut:], b.iloc[:cut]
            for _, s in b.groupby(entity, sort=False):
                yield s[good_prints(s[price].tolist(), jump)]
        if rest is not None and len(rest):
            yield rest[good_prints(rest[price].tolist(), jump)]

    some = bars.where(F.col(entity).isNotNull() & (F.col(price) > 0)).repartition(entity).sortWithinPartitions(entity, order)
    return some.mapInPandas(run, kind)


def spreads(bars: DataFrame, entity: str, order: str, high: str, low: str, close: str, window: int = 63, least: int = 30) -> DataFrame:
    """bars with ar and cs: closing half-spread estimators of Abdi and Ranaldo (2017) and Corwin and Schultz (2012),
    means over the trailing window, 0 at least, null with too few bars. (A27)"""
    w = Window.partitionBy(entity).orderBy(order)
    h, l, c = (F.ln(x) for x in (high, low, close))  # noqa: E741
    b = bars.withColumns({"__h": h, "__l": l, "__c": c, "__m": (h + l) / 2})
    b = b.withColumns({"__h1": F.lead("__h").over(w), "__l1": F.lead("__l").over(w), "__m1": F.lead("__m").over(w)})
    k = 3 - 2 * math.sqrt(2)
    beta = F.pow(F.col("__h") - F.col("__l"), 2) + F.pow(F.col("__h1") - F.col("__l1"), 2)
    gamma = F.pow(F.greatest("__h", "__h1") - F.least("__l", "__l1"), 2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    b = b.withColumns({"__ar": 4 * (F.col("__c") - F.col("__m")) * (F.col("__c") - F.col("__m1")), "__cs": F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))})
    past = w.rowsBetween(-window, -1)  # the last bar's successor isn't known yet
    enough = F.count("__ar").over(past) >= least
    return b.select(*bars.columns, F.when(enough, F.sqrt(F.greatest(F.avg("__ar").over(past), F.lit(0.0)))).alias("ar"), F.when(enough, F.avg("__cs").over(past)).alias("cs"))


def period_spreads(bars: DataFrame, entity: str, order: str, period: Column, high: str, low: str, close: str, window: int = 63, least_bars: int = 10, least_total: int = 30) -> DataFrame:
    """entity, period, ar, cs of each period with enough bars: both estimators over the bars up to its last one.

    The window is the last `window` bars of the entity at the period's end; bars without a full and possible range
    don't count. An entity needs least_total bars, a period least_bars, a window 3."""
    some = bars.where((F.col(high) >= F.col(low)) & (F.col(low) > 0) & (F.col(close) > 0)).withColumn("period", period)
    w = Window.partitionBy(entity).orderBy(order)
    h, l, c = (F.ln(x) for x in (high, low, close))  # noqa: E741
    b = some.withColumns({"__h": h, "__l": l, "__c": c, "__m": (h + l) / 2})
    b = b.withColumns({"__h1": F.lead("__h").over(w), "__l1": F.lead("__l").over(w), "__m1": F.lead("__m").over(w)})
    k = 3 - 2 * math.sqrt(2)
    beta = F.pow(F.col("__h") - F.col("__l"), 2) + F.pow(F.col("__h1") - F.col("__l1"), 2)
    gamma = F.pow(F.greatest("__h", "__h1") - F.least("__l", "__l1"), 2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    b = b.withColumns({"__ar": 4 * (F.col("__c") - F.col("__m")) * (F.col("__c") - F.col("__m1")), "__cs": F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))})
    pairs = w.rowsBetween(1 - window, -1)  # each with its successor, all up to this bar
    in_period, whole = Window.partitionBy(entity, "period"), Window.partitionBy(entity)
    b = b.withColumns({"__ar": F.avg("__ar").over(pairs), "__cs": F.avg("__cs").over(pairs), "__k": F.row_number().over(w), "__n": F.count("*").over(in_period), "__last": F.row_number().over(in_period.orderBy(F.col(order).desc())), "__all": F.count("*").over(whole)})
    b = b.where((F.col("__last") == 1) & (F.col("__n") >= least_bars) & (F.col("__all") >= least_total))
    wide = F.least(F.col("__k"), F.lit(window)) >= 3
    return b.select(entity, "period", F.when(wide, F.sqrt(F.greatest("__ar", F.lit(0.0)))).alias("ar"), F.when(wide, F.col("__cs")).alias("cs"))


def cost_bps(rows: DataFrame, entity: str, period: Column, measured: DataFrame) -> DataFrame:
    """rows with cost_bps: the mean of the measured spreads of the entity's period in basis points, null if unmeasured."""
    ar, cs = F.col("__s.ar"), F.col("__s.cs")
    both = F.when(ar.isNotNull() & cs.isNotNull(), (ar + cs) / 2).otherwise(F.coalesce(ar, cs))
    m = measured.select(F.col(entity).alias("__e"), F.col("period").alias("__p"), F.struct("ar", "cs").alias("__s"))
    r = rows.withColumn("__period", period)
    return r.join(m, (F.col(entity) == F.col("__e")) & (F.col("__period") == F.col("__p")), "left").withColumn("cost_bps", both * 10_000).drop("__e", "__p", "__s", "__period")


#: A day's move of the adjusted close that is an error where the raw close is calm.
JUMP_UP, JUMP_DOWN, CALM = 1.0, -0.5, 0.15


def rebuilt_adjusted(bars: DataFrame, entity: str, order: str, close: str, adjusted: str) -> DataFrame:
    """bars with the adjusted close chained through the raw day's move where it jumps and the raw close doesn't.

    Series without an error keep their values. Closes are above 0."""
    w = Window.partitionBy(entity).orderBy(order)
    move = lambda x: F.col(x) / F.lag(x).over(w) - 1
    b = bars.withColumns({"__ra": move(adjusted), "__rr": move(close)})
    wrong = ((F.col("__ra") > JUMP_UP) | (F.col("__ra") < JUMP_DOWN)) & (F.abs("__rr") < CALM)
    b = b.withColumn("__wrong", F.coalesce(wrong, F.lit(False)))
    step = F.ln(1 + F.coalesce(F.when(F.col("__wrong"), F.col("__rr")).otherwise(F.col("__ra")), F.lit(0.0)))
    chained = F.first(adjusted).over(w) * F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    any_ = F.max("__wrong").over(Window.partitionBy(entity))
    return b.withColumn("__new", F.when(any_, chained).otherwise(F.col(adjusted))).withColumn(adjusted, F.col("__new")).select(*bars.columns)


def rescaled(bars: DataFrame, close: str, adjusted: str, others: Sequence[str]) -> DataFrame:
    """bars with the other prices on the scale of the adjusted close."""
    return bars.withColumns({c: F.col(c) * F.col(adjusted) / F.col(close) for c in others})


def snapshot(bars: DataFrame, entity: str, date: str, quarter_end: Column, stale_days: int = 7) -> DataFrame:
    """The last bar of each quarter, if not staler than so many days at its end."""
    b = bars.withColumn("quarter_end", quarter_end)
    b = b.withColumn("__rn", F.row_number().over(Window.partitionBy(entity, "quarter_end").orderBy(F.col(date).desc())))
    return b.where((F.col("__rn") == 1) & (F.datediff("quarter_end", date) <= stale_days)).drop("__rn")


def checked_value(a: Column, b: Column, factor: float = 3.0) -> Column:
    """a if another source agrees within the factor or is missing, else null."""
    far = F.greatest(a / F.nullif(b, F.lit(0.0)), b / F.nullif(a, F.lit(0.0))) > factor
    return F.when(b.isNull() | (b <= 0) | ~far, a)


def size_band(df: DataFrame, period: str, key: str, code: str, size: str, liquidity: str, low: float, high: float) -> DataFrame:
    """A row a filer, its most liquid code, with size in [low, high)."""
    best = df.withColumn("__rn", F.row_number().over(Window.partitionBy(period, key).orderBy(F.col(liquidity).desc_nulls_last(), F.col(code).asc_nulls_last())))
    return best.where((F.col("__rn") == 1) & (F.col(size) >= low) & (F.col(size) < high)).drop("__rn")


def floors(df: DataFrame, at_least: Mapping[str, float], below: Mapping[str, float] | None = None, rank: str | None = None, skip: int = 0, top: int | None = None) -> DataFrame:
    """Rows of a universe: each column at its floor or above, below its ceiling, ranked after the first `skip` and among `top`.

    Null never passes."""
    ok = F.lit(True)
    for c, v in at_least.items():
        ok = ok & (F.col(c) >= v)
    for c, v in (below or {}).items():
        ok = ok & (F.col(c) < v)
    if rank is not None:
        ok = ok & (F.col(rank) > skip) & (F.lit(True) if top is None else F.col(rank) <= top)
    return df.where(ok)


def trusted_value(a: str, b: str, turnover: str, close: str, most: float, band: tuple[float, float], least_turnover: float, most_close: float) -> Column:
    """struct(value, source): size a where another estimate b agrees within the band, else b, else a if it is traded and priced plausibly."""
    b_ok, a_ok = F.coalesce((F.col(b) > 0) & (F.col(b) <= most), F.lit(False)), F.coalesce(F.col(a) <= most, F.lit(False))
    share = F.col(a) / F.when(F.col(b) > 0, F.col(b))
    pick = lambda v, s: F.struct(v.cast("double").alias("value"), F.lit(s).alias("source"))
    plausible = a_ok & (F.coalesce(F.col(turnover), F.lit(0.0)) >= least_turnover) & F.coalesce(F.col(close) <= most_close, F.lit(False))
    return (
        F.when(b_ok & a_ok & share.between(*band), pick(F.col(a), "checked"))
        .when(b_ok, pick(F.col(b), "other"))
        .when(plausible, pick(F.col(a), "unchecked"))
        .otherwise(pick(F.lit(None), "dropped"))
    )


def rolling_middle(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], k: int, out: str) -> DataFrame:
    """df with out: median of the last k values of x, this one included."""
    return df.withColumn(out, rolling_median(x, by, order, k))
