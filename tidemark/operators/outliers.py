"""Spikes, stuck values and impossible readings: robust exponentially weighted control charts per source."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import table

#: A reading is suspected if it is farther than so many scales from the chart's level. Normal months stay below 5.
LIMIT = 6.0
#: Longest spike, in consecutive readings; a suspicion that lasts longer is a change of level.
LONGEST_SPIKE = 3
#: Weight of a new reading in the level and in the series' own scale.
LEVEL_WEIGHT, SCALE_WEIGHT = 0.7, 0.05
#: Share of the source's scale in the chart's scale; the rest is the series' own.
SOURCE_SHARE = 0.8
#: Residuals are clipped to so many scales before they update level and scale.
CLIP = 3.0
#: Least scale of a log change a month; for readings that usually don't change at all.
LEAST_SCALE = 0.01
#: Least length of a run of equal values that counts as stuck.
STUCK_RUN = 6


def spikes(x: Sequence[float], month: Sequence[float], sigma: float) -> list[int]:
    """Positions of spikes in a series of log readings at rising months, by a control chart of scale sigma a month.

    Suspected readings wait until the series returns (then they are spikes, if far off the level before and after) or
    until more than LONGEST_SPIKE of them are waiting (then the level has changed to their median). Those still
    waiting at the end have no level after them and are none.
    """
    if len(x) < 3:
        return []
    out: list[int] = []
    wait: list[int] = []
    level, at, own = x[0], month[0], sigma * sigma
    prior = SOURCE_SHARE * sigma * sigma
    for i in range(1, len(x)):
        v = x[i]
        r = v - level
        scale = math.sqrt(prior + (1 - SOURCE_SHARE) * own)
        gap = max(1.0, month[i] - at)
        far = LIMIT * scale
        if abs(r) <= far or (abs(r) <= far * math.sqrt(gap) and not (wait and abs(v - x[wait[-1]]) < abs(r))):
            if wait:
                out += [j for j in wait if abs(x[j] - level) > far and abs(x[j] - v) > far]
                wait = []
            c = CLIP * scale * math.sqrt(gap)
            r = min(max(r, -c), c)
            level += LEVEL_WEIGHT * r
            own += SCALE_WEIGHT * (r * r / gap - own)
            at = month[i]
            continue
        wait.append(i)
        if len(wait) > LONGEST_SPIKE:
            old, level, at = level, sorted(x[j] for j in wait)[(len(wait) - 1) // 2], month[i]
            off = [j for j in wait if abs(x[j] - level) > far]
            last = max(j for j in wait if j not in off)
            # a step on the way from one level to the next lies nearer to one of them than a spike beside the change
            out += [j for j in off if j < last and min(abs(x[j] - old), abs(x[j] - level)) > abs(level - old) / 2]
            wait = [j for j in off if j > last]
    return out


def _charts(readings: Sequence[str]):
    """Over rows sorted by series and date: the dates with a spike in any reading. Holds one series at a time."""
    cols = [f"x_{r}" for r in readings]
    scales = [f"s_{r}" for r in readings]

    def whole_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = b["series"].iloc[-1]
            cut = int(b["series"].searchsorted(last)) if b["series"].is_monotonic_increasing else int((b["series"] == last).values.argmax())
            rest = b.iloc[cut:]
            if cut:
                yield b.iloc[:cut]
        if rest is not None and len(rest):
            yield rest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_series(batches):
            series, day = b["series"].tolist(), b["day"].tolist()
            hits: set[int] = set()
            for c, sc in zip(cols, scales):
                x, s = b[c].tolist(), b[sc].tolist()
                start = 0
                for end in range(1, len(series) + 1):
                    if end < len(series) and series[end] == series[start]:
                        continue
                    idx = [i for i in range(start, end) if x[i] == x[i]]
                    sigma = next((s[i] for i in idx if s[i] == s[i]), LEAST_SCALE)
                    hits.update(idx[k] for k in spikes([x[i] for i in idx], [day[i] / 30.44 for i in idx], max(sigma, LEAST_SCALE)))
                    start = end
            at = sorted(hits)
            yield pd.DataFrame({"series": [series[i] for i in at], "day": [day[i] for i in at]}, columns=["series", "day"]).astype("int64")

    return run


def implausible_lists(lists: DataFrame, series: str, date: str, row_id: str, source: str, readings: Sequence[str], sticky: str) -> DataFrame:
    """row_id and reason (impossible, stuck or spike, the first that holds) of each implausible row.

    Impossible: zero, negative or infinite, in any reading; needs no series. Stuck: `sticky` exactly the same in
    STUCK_RUN or more consecutive lists of a series, each but the first; a null breaks the run. Spike: one to
    LONGEST_SPIKE consecutive readings far off the level before and after by the standards of the series' source.
    Nulls and NaN are no case. Copies of a list (same series and date) share its verdict; where copies differ, the
    reading with the least row_id counts. Rows without series or date can only be impossible. A lasting change,
    and so a split, is none. Extra columns play no part.

    Plan: copies are combined before the shuffle, so a series has one row a date; the source's scale is the median
    absolute log change over all its series. Charts run over sorted partitions, one series in memory at a time.
    """
    value = {r: F.when(~F.isnan(F.col(r).cast("double")), F.col(r).cast("double")) for r in readings}
    rows = lists.select(F.col(row_id).alias("row_id"), F.col(series).cast("long").alias("series"), F.unix_date(F.col(date).cast("date")).cast("long").alias("day"), F.col(source).alias("source"), *[value[r].alias(r) for r in readings])
    bad = F.lit(False)
    for r in readings:
        bad = bad | F.coalesce((F.col(r) <= 0) | (F.col(r) == float("inf")), F.lit(False))
    keyed = rows.where(F.col("series").isNotNull() & F.col("day").isNotNull())
    once = keyed.groupBy("series", "day").agg(F.min("source").alias("source"), *[F.min_by(r, F.when(F.col(r).isNotNull(), F.col("row_id"))).alias(r) for r in readings])
    w = Window.partitionBy("series").orderBy("day")
    ok = lambda r: F.when((F.col(r) > 0) & (F.col(r) < float("inf")), F.ln(F.when((F.col(r) > 0), F.col(r))))
    once = once.select("*", *[ok(r).alias(f"x_{r}") for r in readings])
    once = once.withColumn("same", F.col(sticky) == F.lag(sticky).over(w)).withColumn("run", F.sum(F.when(F.coalesce("same", F.lit(False)), 0).otherwise(1)).over(w))
    once = once.withColumn("run_n", F.count("*").over(Window.partitionBy("series", "run"))).withColumn("stuck", F.coalesce("same", F.lit(False)) & (F.col("run_n") >= STUCK_RUN))
    moves = once.select("source", *[F.abs(F.col(f"x_{r}") - F.lag(f"x_{r}").over(w)).alias(r) for r in readings])
    scale = moves.groupBy("source").agg(*[(1.4826 * F.percentile_approx(r, 0.5, 10000)).alias(f"s_{r}") for r in readings])
    charted = once.join(scale.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left")
    charted = charted.select("series", "day", *[f"x_{r}" for r in readings], *[f"s_{r}" for r in readings]).repartition("series").sortWithinPartitions("series", "day")
    spiky = charted.mapInPandas(_charts(readings), "series long, day long").withColumn("spike", F.lit(True))
    odd = once.where("stuck").select("series", "day", F.lit(True).alias("stuck"), F.lit(None).cast("boolean").alias("spike")).unionByName(spiky.withColumn("stuck", F.lit(None).cast("boolean")))
    odd = odd.groupBy("series", "day").agg(F.max("stuck").alias("stuck"), F.max("spike").alias("spike"))
    got = rows.withColumn("bad", bad).join(odd, ["series", "day"], "left")
    reason = F.when(F.col("bad"), "impossible").when(F.col("stuck"), "stuck").when(F.col("spike"), "spike")
    return got.select(F.col("row_id").alias(row_id), reason.alias("reason")).where(F.col("reason").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "universe_lists")
    return implausible_lists(lists, "cik", "list_date", "list_id", "source", ["close_px", "shares", "mcap"], "close_px").select("list_id")


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
