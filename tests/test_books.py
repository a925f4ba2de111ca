"""Books over names that come and go: equal to their SQL, and without a row for each absence."""

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest

from tidemark import registry


def _panel(spark, folder):
    """400 names in a few of 400 days each, most of them apart."""
    rnd, panel = random.Random(11), []
    for i in range(400):
        for k in {i, i + 1, i + 2, i + 2 + rnd.randrange(1, 9), rnd.randrange(400)}:
            panel.append((f"n{i}", datetime(2020, 1, 1, 21, tzinfo=timezone.utc) + timedelta(days=3 * min(k, 399))))
    panel = [(j, *p, "g") for j, p in enumerate(sorted(set(panel)))]
    x = lambda: rnd.choice([None, float("nan"), rnd.random(), rnd.random(), rnd.random()])
    scored = [(j, j, rnd.choice([0.5, rnd.random(), rnd.random()]) if j % 20 else None, x(), 1, x()) for j, *_ in panel]
    spark.createDataFrame(panel, "panel_id long, entity_id string, decision_time timestamp, grp string").write.parquet(f"{folder}/panel.parquet")
    spark.createDataFrame(scored, "score_seq long, panel_id long, score double, fwd_return double, block int, rt_cost double").write.parquet(f"{folder}/scored.parquet")
    return len(panel)


def _written(spark):
    """Records that the stages so far have put into shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _check(spark, folder, name):
    n, before = _panel(spark, folder), _written(spark)
    got = [tuple(r) for r in registry.CORE[name](spark, folder).collect()]
    assert _written(spark) - before < 10 * n
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in ("panel", "scored"):
        con.sql(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(registry.CORE_SQL[name]).fetchall()
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got), sorted(want)):
        assert a == pytest.approx(b)


def test_band_without_absences(spark, tmp_path):
    _check(spark, str(tmp_path), "band_portfolio")


def test_top_without_absences(spark, tmp_path):
    _check(spark, str(tmp_path), "topk_portfolio")


def test_summary_without_absences(spark, tmp_path):
    _check(spark, str(tmp_path), "book_summary")


def test_periodic_without_absences(spark, tmp_path):
    _check(spark, str(tmp_path), "periodic_portfolio")
