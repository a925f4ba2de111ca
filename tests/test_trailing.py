"""Totals over the span before each row, whatever the key holds."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows

SCHEMA = "id long, k string, t long, x double, c string"


def test_trailing_against_brute_force(spark):
    rnd, span = random.Random(2), 100
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(-400, 400), 100 * rnd.randrange(-4, 4)]), rnd.choice([None, 0.0, -1.0, 0.5]), rnd.choice("xyz") if i % 5 else None) for i in range(400)]
    rows += [(400, "far", 253_402_300_799_999_999, 1.0, "x"), (401, "far", 253_402_300_799_999_899, 2.0, "y"), (402, "far", 253_402_300_799_999_898, 4.0, "z")]
    got = {r.id: r for r in windows.trailing(spark.createDataFrame(rows, SCHEMA), "k", "t", span, "x", "c").collect()}
    assert len(got) == len(rows)
    for i, k, t, x, c in rows:
        near = [r for r in rows if r[1] == k and t - span <= r[2] < t]
        values = [r[3] for r in near if r[3] is not None]
        assert (got[i].x, got[i].c, got[i].t) == (x, c, t)
        assert (got[i].n, got[i].kinds) == (len(near), len({r[4] for r in near} - {None}))
        assert (got[i].total, got[i].gross) == (pytest.approx(sum(values)), pytest.approx(sum(map(abs, values))))
    assert windows.trailing(spark.createDataFrame([], SCHEMA), "k", "t", span, "x", "c").collect() == []


def test_one_hot_entity_of_many_events(spark, tmp_path):
    from tidemark import registry

    e = spark.range(60_000).select(F.col("id").alias("event_id"), F.lit("69999999").alias("entity"), F.timestamp_micros(F.col("id") * 300_000_000).alias("published_at"), F.lit(1.0).alias("direction"), F.concat(F.lit("c"), F.col("id") % 9).alias("category"))
    e.write.parquet(f"{tmp_path}/eight_k_events.parquet")
    began = time.time()
    got = registry.CORE["event_direction_share"](spark, str(tmp_path)).agg(F.count("*"), F.max("n"), F.min("kinds"), F.sum("n")).first()
    took = time.time() - began
    most = 90 * 288
    assert tuple(got) == (60_000, most, 0, most * (most - 1) // 2 + (60_000 - most) * most)
    assert took < 60  # comparing each event with its span takes a billion steps in one task
