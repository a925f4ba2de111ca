"""Streaming forms: late data by watermark, filings once, totals by day; and the last value known, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_daily_totals(events: DataFrame, at: str, keys: list[str], once: list[str], value: str, late: str = "2 days") -> DataFrame:
    """keys, window, n, total of each day; an event delivered again within the watermark counts once."""
    e = events.withWatermark(at, late).dropDuplicatesWithinWatermark(once)
    return e.groupBy(*keys, F.window(at, "1 day")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def streamed_latest(obs: DataFrame, key: str, at: str, seq: str, value: str) -> DataFrame:
    """key, at, seq, value: the newest observation by (at, seq) whenever a batch brings one; missing values count."""
    schema = f"{key} string, at timestamp, seq long, value double"

    def step(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        moved = False
        for pdf in pdfs:
            for t, s, v in zip(pdf[at], pdf[seq], pdf[value]):
                if pd.isna(t):
                    continue
                new = (int(pd.Timestamp(t).value // 1000), int(s), None if pd.isna(v) else float(v))
                if best is None or new[:2] > tuple(best)[:2]:
                    best, moved = new, True
        if moved:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], "at": [pd.Timestamp(best[0], unit="us")], "seq": [best[1]], "value": [best[2]]}).astype({"value": "float64"})

    return obs.groupBy(key).applyInPandasWithState(step, schema, "at long, seq long, value double", "update", GroupStateTimeout.NoTimeout)
