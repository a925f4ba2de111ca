"""Fundamentals, costs, universes, tracking and grading on small tables."""

from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import fundamentals as X
from tidemark.operators import grading as G
from tidemark.operators import prices as P
from tidemark.operators import ridge as M
from tidemark.operators import tracking as K
from tidemark.sources.stamps import zone_intervals

U = timezone.utc
FACTS = "entity string, concept string, end date, filed date, val double"


def test_annual_ratios(spark):
    rows = [("a", "revenue", date(2019, 12, 31), date(2020, 2, 1), 100.0), ("a", "revenue", date(2019, 12, 31), date(2021, 2, 1), 999.0), ("a", "revenue", date(2020, 12, 31), date(2021, 2, 3), -50.0), ("a", "net_income", date(2020, 12, 31), date(2021, 2, 9), 5.0), ("a", "total_assets", date(2020, 12, 31), date(2021, 2, 9), 0.0), ("b", "revenue", date(2020, 12, 31), date(2021, 1, 1), None)]
    got = {(r.entity, r.end): r for r in X.annual_ratios(spark.createDataFrame(rows, FACTS)).collect()}
    last = got["a", date(2020, 12, 31)]
    assert last.revenue_growth == -1.5 and last.net_margin == -0.1 and last.roa is None and last.filed == date(2021, 2, 9)
    assert got["a", date(2019, 12, 31)].revenue_growth is None and got["b", date(2020, 12, 31)].filed is None
    assert X.annual_ratios(spark.createDataFrame([], FACTS)).collect() == []


def test_quarterly_features_and_their_instants(spark):
    q = lambda y, m, c, v, filed=None: ("a", c, date(y, m, 28), filed or date(y, m, 28), v)
    rows = [q(2020, 3, "revenue", 100.0), q(2020, 6, "revenue", 110.0), q(2021, 3, "revenue", 150.0), q(2021, 3, "cost_of_revenue", 90.0), q(2021, 3, "inventory", 45.0), q(2021, 3, "rnd", 15.0, date(2021, 9, 1)), ("a", "inventory", date(2021, 6, 28), date(2021, 6, 28), 1.0)]
    got = {r.end: r for r in X.quarterly_features(spark.createDataFrame(rows, FACTS), extended=True).collect()}
    assert set(got) == {date(2020, 3, 28), date(2020, 6, 28), date(2021, 3, 28)}  # no flow, no date
    r = got[date(2021, 3, 28)]
    assert r.q_rev_growth_yoy == pytest.approx(0.5) and r.q_gross_margin == pytest.approx(0.4) and r.q_inventory_days == pytest.approx(45.5) and r.q_rnd_intensity is None and r.q_rev_growth_qoq is None
    assert got[date(2020, 6, 28)].q_rev_growth_qoq == pytest.approx(0.1)
    o = X.as_observations(spark.createDataFrame([("a", date(2021, 3, 13), date(2021, 3, 13), 1.0), ("a", date(2021, 1, 1), None, 1.0)], "entity string, end date, filed date, x double"), ["entity"], ["x"], "America/New_York").collect()
    assert [r.available_at.astimezone(U) if r.available_at.tzinfo else r.available_at.replace(tzinfo=U) for r in o] == [datetime(2021, 3, 14, 5, tzinfo=U)]


def test_zone_intervals_are_contiguous():
    spans = zone_intervals("America/New_York")
    assert spans[0][0] is None and all(b[2] == a[1] - a[3] for a, b in zip(spans, spans[1:]))


def test_values_floors_and_rebuilt_closes(spark):
    rows = [(1, 10.0, 12.0, 1.0, 5.0), (2, 10.0, 1.0, 1.0, 5.0), (3, 10.0, None, 1.0, 5.0), (4, 10.0, None, 0.0, 5.0), (5, 1e13, -1.0, 1.0, 5.0), (6, None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, turn double, px double")
    got = {r.id: (r.v.value, r.v.source) for r in df.select("id", P.trusted_value("a", "b", "turn", "px", 1e12, (0.5, 4.0), 0.5, 50.0).alias("v")).collect()}
    assert got == {1: (10.0, "checked"), 2: (1.0, "other"), 3: (10.0, "unchecked"), 4: (None, "dropped"), 5: (None, "dropped"), 6: (None, "dropped")}
    assert [r.id for r in P.floors(df, {"a": 1.0}, {"a": 1e12}, rank="id", skip=1, top=3).orderBy("id").collect()] == [2, 3]
    bars = spark.createDataFrame([("x", k, 10.0 + k, adj) for k, adj in enumerate([10.0, 11.0, 60.0, 65.0])] + [("y", 0, 5.0, 5.0)], "e string, k int, close double, adj double")
    got = {(r.e, r.k): r.adj for r in P.rebuilt_adjusted(bars, "e", "k", "close", "adj").collect()}
    assert got["x", 2] == pytest.approx(11 * 12 / 11) and got["x", 3] == pytest.approx(12 * 65 / 60) and got["y", 0] == 5.0


def test_section_cut_and_questions(spark):
    df = spark.createDataFrame([("COVER page Item 2.02 Results",), ("no item",), (None,)], "t string")
    assert [r[0] for r in df.select(T.section_cut(F.col("t"))).collect()] == ["Item 2.02 Results", "no item", None]
    q = T.Question("q", "choice", "?", ("a", "b"), {"a": "up", "b": "down"})
    got = spark.createDataFrame([("down up",), ("nothing",), (None,)], "t string").select(T.keyword_answer(F.col("t"), q).alias("x")).collect()
    assert [round(r.x.probs["b"], 3) for r in got] == [0.9, 0.5, 0.5] and got[0].x.evidence == "down"


def test_efficacy_equals_fits_with_and_without(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, 3))
    y = x[:, 0] + 0.1 * rng.normal(size=n)
    rows = [(datetime(2020 + i % 3, 1, 1, tzinfo=U), datetime(2024, 1, 1, tzinfo=U), *map(float, x[i]), float(y[i])) for i in range(n)]
    g = M.grams(spark.createDataFrame(rows, "t timestamp, e timestamp, a double, b double, c double, y double"), ["a", "b", "c"], "y", "t", "e")
    got = {q: (gain, say) for q, gain, say in G.question_efficacy(g, {"one": ["a"], "two": ["b", "c"]}, lambda t: t.year)}

    def r2(cols):
        pred = np.zeros(n)
        fold = np.arange(n) % 3
        for f in range(3):
            tr = fold != f
            mx, my = x[tr][:, cols].mean(0), y[tr].mean()
            xc = x[tr][:, cols] - mx
            b = np.linalg.solve(xc.T @ xc + 10 * np.eye(len(cols)), xc.T @ (y[tr] - my))
            pred[~tr] = my + (x[~tr][:, cols] - mx) @ b
        return 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert got["one"][0] == pytest.approx(r2([0, 1, 2]) - r2([1, 2])) and got["one"][1] == "keep"
    assert got["two"][0] == pytest.approx(r2([0, 1, 2]) - r2([0])) and got["two"][1] == "drop"


def test_scores_bootstrap_and_identification(spark):
    s = G.harness_score({"a": dict(a=1, b=1, gains={"r2": 0.1, "react": 0.05}, e=1)})["a"]
    assert s["C"] == 0.75 and s["D"] == 0.0 and s["S"] == pytest.approx(0.3 + 0.25 + 0.3 * 0.75 + 0.05)
    new, old = {str(i): np.full(3, i + 1.0) for i in range(20)}, {str(i): np.full(3, float(i)) for i in range(20)}
    assert G.paired_bootstrap(new, old, np.mean, 50) == {"delta": pytest.approx(1), "lo": pytest.approx(1), "hi": pytest.approx(1)}
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5}, "a"), ({"a": 0.9, "b": 0.1}, "b"), ({}, "a"), (None, "a")], "p map<string,double>, t string")
    got = G.identification_gate(df, "p", "t").first()
    assert got.n == 4 and got.accuracy == pytest.approx(0.125)


def test_joint_attribution_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for p in range(6):
        x = rng.normal(size=(40, 2))
        r = np.argsort(np.argsort(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=40))) + 1.0
        z = r / 40 - 0.5
        a = np.column_stack([np.ones(40), x])
        want.append(np.linalg.lstsq(a, z, rcond=None)[0][1:])
        rows += [(datetime(2020, 1 + p, 1, tzinfo=U), float(r[i]), float(x[i, 0]), float(x[i, 1])) for i in range(40)]
    got = {r.field: r for r in K.attribution_table(spark.createDataFrame(rows, "t timestamp, resid double, x1 double, x2 double"), ["x1", "x2"], "t", {"x1": -1.0}).collect()}
    mean = np.mean(want, axis=0)
    assert got["x1"].slope_joint == pytest.approx(mean[0]) and got["x2"].slope_joint == pytest.approx(mean[1]) and got["x1"].status == "over-weighted" and got["x1"].periods == 6
