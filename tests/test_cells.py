"""Operators over cells of time and value: hot keys, nulls, ties, empty tables, against brute force."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import cells, grading, ranks, scoring, windows

U = timezone.utc
T0 = datetime(2020, 1, 1, tzinfo=U)


def _rows(seed, n, spread_days):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["hot"] * 5 + ["a", "b", None])
    return rnd, [(key(), T0 + timedelta(hours=rnd.randrange(24 * spread_days)), i, rnd.choice([None, 1.0, 2.5, float(i)])) for i in range(n)]


@pytest.mark.parametrize(("inclusive", "forward"), [(False, False), (True, False), (False, True), (True, True)])
def test_asof_over_many_cells(spark, inclusive, forward):
    rnd, right = _rows(3, 400, 900)
    left = [(k, t, i) for k, t, i, _ in _rows(4, 300, 900)[1]] + [(None, None, 999), (right[0][0], right[0][1], 1000)]
    got = A.asof(spark.createDataFrame(left, "k string, t timestamp, id long"), "t", spark.createDataFrame(right, "k string, at timestamp, seq long, x double"), "at", ["k"], "seq", ["x"], inclusive=inclusive, forward=forward)
    have = {r.id: (r.x, r.known_at) for r in got.collect()}
    for k, t, i in left:
        ok = [r for r in right if r[0] == k and t is not None and (r[1] > t if forward else r[1] < t or (inclusive and r[1] == t) if not forward else False or r[1] == t and inclusive)]
        if forward and t is not None:
            ok = [r for r in right if r[0] == k and (r[1] > t or (inclusive and r[1] == t))]
        best = (min if forward else max)(ok, key=lambda r: (r[1], r[2]), default=None)
        assert have[i] == ((best[3], best[1].replace(tzinfo=None)) if best else (None, None)) or (best and have[i][0] == best[3] and have[i][1].replace(tzinfo=U) == best[1])


def test_attach_over_many_cells(spark):
    rnd, obs = _rows(5, 300, 700)
    obs = [(*r, rnd.choice("fg")) for r in obs]
    panel = [(k, t, i) for k, t, i, _ in _rows(6, 200, 700)[1]]
    got = A.attach(spark.createDataFrame(panel, "e string, t timestamp, id long"), "e", "t", spark.createDataFrame(obs, "e string, at timestamp, seq long, x double, feature string"), "feature", "x", "at", "seq", ["f", "g"])
    for r in got.collect():
        e, t = next((k, t) for k, t, i in panel if i == r.id)
        for f in "fg":
            best = max((o for o in obs if o[0] == e and o[4] == f and o[1] < t), key=lambda o: (o[1], o[2]), default=None)
            assert r[f"x_{f}"] == (best[3] if best else None)


def test_running_means_with_a_lag(spark):
    rnd, rows = _rows(7, 250, 400)
    df = spark.createDataFrame(rows, "k string, t timestamp, id long, x double")
    for lag in (0, 30):
        got = {r.id: r.m for r in windows.shrunk_means(df, "x", "t", [[], ["k"]], 5.0, lag_days=lag, out="m").collect()}
        for k, t, i, _ in rows:
            mean, seen = 0.0, 0
            for ok in (lambda r: True, lambda r: k is not None and r[0] == k):
                v = [r[3] for r in rows if ok(r) and r[3] is not None and r[1] + timedelta(days=lag) < t]
                seen += len(v)
                mean = (sum(v) + 5 * mean) / (len(v) + 5) if v else mean
            assert got[i] == pytest.approx(mean) if seen else got[i] is None
    assert windows.shrunk_means(df.limit(0), "x", "t", [[]], 5.0).collect() == []


def test_exact_quantiles_and_what_uses_them(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, float("nan"), rnd.gauss(0, 5), 1.0, -1.0, 0.0, -0.0, 1e9])) for _ in range(500)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in cells.exact_quantiles(df, "x", ["g"], [0.0, 0.1, 0.5, 0.97], "q").collect()}
    for g in ("hot", "b", None):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert np.allclose(got[g], np.quantile(v, [0.0, 0.1, 0.5, 0.97]))
    assert "none" not in got
    filled = scoring.fill_costs(spark.createDataFrame([(1.0,), (None,), (5.0,), (2.0,), (4.0,)], "rt_cost double"))
    assert sorted(r.rt_cost for r in filled.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert scoring.fill_costs(df.select(F.col("x").alias("rt_cost")).limit(0)).collect() == []
    assert ranks.winsorized(df, "x", "g", 0.1, 0.9).count() == len(rows)


def test_auc_with_ties(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([0.1, 0.2, -0.3, 0.0, 1e6, None]), rnd.random() < 0.4) for _ in range(300)]
    got = grading.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()
    p, n = [s for s, y in rows if y and s is not None], [s for s, y in rows if not y and s is not None]
    assert got.auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)))
