"""Studies, registry, loop, decider, sources and streaming on a small planted market."""

import gzip
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.cli import demo_panel
from tidemark.functions import text as X
from tidemark.operators import grading, labels, prices, ridge, scoring
from tidemark.plans import decide, loop
from tidemark.plans import governance as V
from tidemark.plans.study import Candidate, CohortTest, SourceSpec, Study, build_panel
from tidemark.session import cut_lineage
from tidemark.sources import files
from tidemark.sources.synthetic import SyntheticMarket


@pytest.fixture(scope="module")
def panel(spark):
    p = cut_lineage(demo_panel(spark, 60, 3).where("fwd_return is not null"))
    return p


def study(panel, tmp_path, base=()):
    return Study(panel, list(base), V.Periods(date(2010, 1, 1), date(2012, 1, 1), date(2012, 7, 1), date(2013, 1, 1)), V.Registry(tmp_path / "r.csv", "demo"), ridge.WalkForward("quarter", 10.0, 6))


def test_planted_number_and_text_are_found_and_noise_is_not(panel, tmp_path):
    s = study(panel, tmp_path)
    got = {t.candidate: t for t in s.discover([Candidate("planted"), Candidate("outlook"), Candidate("noise_1")])}
    assert got["planted:level"].verdict == "kept" and got["planted:level"].t > 5
    assert got["outlook:level"].t > 3 and got["noise_1:level"].verdict == "dropped"
    assert s.discover([Candidate("planted")]) == [] and s.registry.n_judged() == 3
    assert s.registry.bar() == pytest.approx(V.required_t(4)) and s.registry.check_uses() >= 1


def test_report_and_gates(panel, tmp_path):
    s = study(panel, tmp_path, ["planted", "outlook"])
    r = s.report()
    assert r["ic"]["mean"] > 0.1 and r["books"]["band"]["periods"] > 3
    assert s.coverage()["planted"] > 0.9
    with pytest.raises(PermissionError):
        s.report("holdout")
    with pytest.raises(PermissionError):
        s.report("check")
    with pytest.raises(PermissionError):
        V.HoldoutLock(tmp_path / "h").unlock("  ")


def test_panel_rules(spark, panel):
    uni = panel.select("entity_id", "decision_time", "grp")
    obs = SyntheticMarket(entities=60).observations(spark)
    with pytest.raises(ValueError):
        build_panel(uni, [SourceSpec(obs, ("planted",)), SourceSpec(obs, ("planted",))])
    p = build_panel(uni.limit(5), [SourceSpec(obs, ("planted", "absent"))])
    assert p.where("absent is not null").count() == 0
    late = panel.select("entity_id", "decision_time", F.col("decision_time").alias("at_x"))
    with pytest.raises(labels.PointInTimeError):
        labels.check_panel(late, "decision_time", ["at_x"])


def test_walk_forward_equals_direct_ridge(panel):
    rows = panel.select("decision_time", "label_end", "planted", "noise_1", "fwd_return").toPandas().dropna()
    d = panel.sparkSession.createDataFrame(rows)
    g = ridge.grams(d, ["planted", "noise_1"], "fwd_return", "decision_time", "label_end")
    x, y = rows[["planted", "noise_1"]].to_numpy(), rows.fwd_return.to_numpy()
    xc = x - x.mean(0)
    b = np.linalg.solve(xc.T @ xc + 10 * np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(ridge.solve(g.mats.sum(0), 10.0)[1:], b)
    assert np.allclose(ridge.least_squares(g.keep(["planted"]).mats.sum(0)), np.linalg.lstsq(xc[:, :1], y - y.mean(), rcond=None)[0])
    assert ridge.WalkForward("quarter", 10.0, 6).best_half_life(g, max(g.times), [6, 24], d, "fwd_return", "decision_time", periods=4) in (6, 24)
    assert ridge.WalkForward("quarter", 10.0, 6).best_half_life(g, min(g.times), [6, 24], d, "fwd_return", "decision_time") is None


def test_loop_and_replay(panel, tmp_path):
    rows = panel.where(F.col("decision_time") < F.lit(datetime(2012, 1, 1, tzinfo=UTC)))
    times = [r[0] for r in rows.select("decision_time").distinct().orderBy("decision_time").collect()][-3:]
    reg = V.Registry(tmp_path / "r.csv", "demo")
    out = loop.replay(rows, loop.ModelConfig(("planted", "noise_1")), times, walk=ridge.WalkForward("quarter", 10.0, 6), registry=reg, settings=loop.LoopsConfig(persist=1, cooldown=0))
    assert out["periods"] > 5 and "planted" in out["config"].features
    assert loop.flips([1, -1, 0, 1]) == 2 and loop.meaningful([1.0, 0.1, -1.0]) == [1, 0, -1] and loop.goes_back("a b c d", ["a b c d"])
    share = panel.select("entity_id").distinct().withColumn("a", loop.acceptance(0.4)).collect()
    assert all(r.a == loop.accepts(r.entity_id, 0.4) for r in share)


def test_question_loop():
    q = X.Question("a", "yes_no", "Is it?", (), {"yes": "x"})
    s = X.QuestionSet("s", ("release",), (q,))
    ql = loop.QuestionLoop(s, lambda z: 0.1 * z.questions[0].version)
    assert ql.run([X.Question("a", "yes_no", "Is it so?", (), {"yes": "y"})]).questions[0].version == 2
    assert s.fingerprint() != ql.questions.fingerprint() and s.without("a").questions == ()
    with pytest.raises(ValueError):
        X.Question("b", "choice", "Which?", ("only",))


def test_decider(panel, tmp_path):
    d = panel.where("planted is not null").withColumn("score", F.col("planted"))
    p = decide.prepare(d, ["planted", "noise_1"], 4, seed=1).cache()
    assert p.groupBy("decision_time", "grp", "batch").count().where("count <> 4").count() == 0
    some = p.where(F.col("decision_time") < F.lit(datetime(2010, 6, 1, tzinfo=UTC)))
    records = decide.Session(decide.NoDecider()).run(some)
    got = decide.grade(some, records)
    assert got["periods"] >= 3 and got["edge"] > 0 and not any(r["override"] for r in records)
    sizer = decide.Sizer()
    decide.Session(sizer).run(some)
    assert sizer.chars > 100
    led = V.Ledger(tmp_path / "l.csv", {"decide": 1.0}, {"sizer": 1.0}, {"m": (1.0, 2.0)})
    with pytest.raises(V.OverBudget):
        decide.Session(decide.Sizer(), led, lambda b: 0.6).run(some)
    assert led.spent(step="decide") == pytest.approx(0.6) and led.price("m", 10**6, 10**6) == 3.0
    decide.log_decider(V.Registry(tmp_path / "r.csv", "demo"), "none", got)


def test_cohort_test(spark, panel):
    m = SyntheticMarket(entities=60, end=date(2012, 12, 31))
    b = m.bars(spark)
    w = labels.daily_returns(b.withColumn("ended", F.lit(False)), "entity_id", "close_at", "price", "ended").select("entity_id", F.to_date("close_at").alias("day"), "r")
    t = CohortTest(("planted",), ("planted",), 0.2, 30).run(panel.where("month(decision_time) in (1, 4, 7, 10)"), w)
    rows = t.collect()
    assert len(rows) > 8 and sum(r.excess for r in rows) > 0


def test_registry_and_ledger_tables(spark):
    r = spark.createDataFrame([("m", "test", "2.5", 1, "tuning", "kept"), ("m", "test", "", 1, "tuning", ""), ("m", "loop_internal", "", 7, "", ""), ("m", "check", "1", 1, "check", "")], "market string, kind string, t string, count long, stage string, verdict string")
    assert V.bar_counts(r).first().asDict() == {"market": "m", "judged": 8, "checks": 1, "kept": 1}
    led = spark.createDataFrame([("a", 1.0), ("a", 0.5)], "step string, usd double")
    caps = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "step string, cap double")
    assert {tuple(x) for x in V.spend_by(led, caps).collect()} == {("a", 2.0, 1.5), ("b", 1.0, 0.0)}
    assert scoring.mde(0.1, 100, 2.0) > 0.02 and scoring.label_overlap(21, 5) == 5


def test_csv_market(spark, tmp_path):
    (tmp_path / "p.csv").write_text("entity,date,close,volume\nNA,2021-01-01,1.5,10\nNA,2021-01-02,,10\nB,2021-03-01,2,x\n")
    b = {(r.entity_id, r.date): (r.price, r.volume, r.ended) for r in files.csv_bars(spark, str(tmp_path / "p.csv")).collect()}
    assert b["NA", date(2021, 1, 1)] == (1.5, 10.0, True) and b["NA", date(2021, 1, 2)][0] is None and b["B", date(2021, 3, 1)] == (2.0, None, False)
    (tmp_path / "s.csv").write_text("entity,available_at,feature,value\nA,2021-01-01,flow,1\nA,2021-01-01 10:00,flow,oops\nA,2021-01-01T10:00:00Z,flow,NaN\n")
    s = files.csv_signals(spark, str(tmp_path / "s.csv"), "America/New_York", "csv").orderBy("seq").collect()
    assert [r.value for r in s] == [1.0, None, None] and s[0].available_at.hour in (5, 0)
    (tmp_path / "d.csv").write_text('entity,available_at,doc_type,text\nA,2021-01-01,post,"two\nlines"\nA,2021-01-02,post,\n')
    d = files.csv_documents(spark, str(tmp_path / "d.csv"), "UTC").collect()
    assert {r.text for r in d} == {"two\nlines", ""} and len({r.doc_id for r in d}) == 2
    (tmp_path / "bad.csv").write_text("entity,available_at,feature,value\nA,soon,flow,1\n")
    with pytest.raises(ValueError):
        files.csv_signals(spark, str(tmp_path / "bad.csv"), "UTC", "csv")
    with gzip.open(tmp_path / "AAA.csv.gz", "wt") as f:
        f.write("date,close,volume\n2021-01-01,3,5\n")
    assert tuple(files.vendor_bars(spark, str(tmp_path)).first()) == ("AAA", date(2021, 1, 1), 3.0, 3.0, 3.0, 3.0, 5.0)


def test_other_sources(spark, tmp_path):
    sym = spark.createDataFrame([("ABCDW",), ("ABC",), ("AB-C",), (None,)], "code string")
    assert [r.code for r in files.common_symbols(sym, sym, "code").collect()] == ["ABC"]
    trans = spark.createDataFrame([("a", "P", 2.0, 3.0), ("a", "A", 2.0, 3.0), ("b", "S", 1.0, 1.0)], "accession string, code string, shares double, price double")
    own = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "z")], "accession string, owner string")
    fil = spark.createDataFrame([("a", "4"), ("b", "5")], "accession string, form string")
    got = files.bulk_trades(trans, own, fil).collect()
    assert len(got) == 1 and got[0].usd == 6.0 and got[0].owner == "y"
    assert files.empty_observations(spark).count() == 0
    docs = spark.createDataFrame([("e", datetime(2020, 1, 1, tzinfo=UTC), "r", "1", None)], "entity_id string, available_at timestamp, doc_type string, doc_id string, text string")
    assert files.FrameDocuments(docs).documents(datetime(2020, 1, 2, tzinfo=UTC)).first().text == ""
    with pytest.raises(ValueError):
        files.FrameDocuments(docs.union(docs))
    with pytest.raises(labels.PointInTimeError):
        labels.validate(docs.withColumn("available_at", F.col("available_at").cast("timestamp_ntz")), ["text"], "available_at")
    html = spark.createDataFrame([("a", "<html><script>x</script><p>Net&nbsp;income&amp;more</p> SIGNATURE J. Doe</html>")], "accession string, html string")
    man = spark.createDataFrame([("a", 1, "2020-01-01"), ("a", 1, "2020-01-02")], "accession string, cik long, filed string")
    out = files.filing_documents(man, html, spark.createDataFrame([(1, "AA"), (1, "AB")], "cik long, code string"), F.to_timestamp("filed")).collect()
    assert {r.entity_id for r in out} == {"AA", "AB"} and out[0].text == "Net income&more"
    (tmp_path / "f.json").write_text('{"cik": 5, "facts": {"gaap": {"Assets": {"units": {"USD": [{"end": "2020-12-31", "filed": "2021-02-01", "form": "10-K", "val": 7}]}}}}}')
    f = files.json_facts(spark, str(tmp_path / "f.json")).first()
    assert (f.cik, f.concept, f.unit, f.val) == (5, "Assets", "USD", 7.0)
    files.write_tables(str(tmp_path / "o"), {"t": sym}, "csv")
    made = []
    make = lambda: (made.append(1), sym)[1]
    assert V.cached(str(tmp_path), V.fingerprint("a", 1), make, spark).count() == V.cached(str(tmp_path), V.fingerprint("a", 1), make, spark).count() == 4 and made == [1]


def test_schedules():
    s = labels.schedule(date(2021, 1, 1), date(2021, 4, 1), "trading", "monthly", "America/New_York", "16:00", 30)
    assert [x.isoformat() for x in s] == ["2021-01-29T21:30:00+00:00", "2021-02-26T21:30:00+00:00", "2021-03-31T20:30:00+00:00"]
    assert len(labels.schedule(date(2021, 1, 1), date(2021, 1, 11), "continuous", "daily", "UTC", "00:00")) == 10
    assert labels.schedule(date(2021, 1, 1), date(2021, 1, 20), "trading", "weekly", "UTC", "00:00")[0].day == 1
    with pytest.raises(ValueError):
        labels.schedule(date(2021, 1, 1), date(2021, 2, 1), "trading", "hourly", "UTC", "00:00")


def test_bad_prints_and_replayed_answers(spark):
    assert prices.good_prints([1.0, 9.0, 1.1, 1.2, 5.0, 5.1]) == [True, False, True, True, True, True]
    bars = spark.createDataFrame([("a", i, p) for i, p in enumerate([1.0, 9.0, 1.1, None, 0.0, 1.2])], "e string, k int, p double")
    assert [r.p for r in prices.drop_bad_prints(bars, "e", "k", "p").orderBy("k").collect()] == [1.0, 1.1, 1.2]
    st = spark.createDataFrame([("d1", "e1", 1.0), ("d1", None, 2.0)], "doc_id string, entity_id string, v double")
    docs = spark.createDataFrame([("d1", "e1"), ("d1", "e2"), ("d2", "e1")], "doc_id string, entity_id string")
    assert {(r.doc_id, r.entity_id, r.v) for r in X.ReplayReader(st, ["v"]).join(docs).collect()} == {("d1", "e1", 1.0), ("d1", "e2", 2.0), ("d2", "e1", None)}
    one = spark.createDataFrame([("Acme Corp rose; ACME and acme fell. AC1 too, AC12 not.",)], "t string")
    m = one.select(X.mask(F.col("t"), F.lit("Acme Corp"), F.lit("AC1")).alias("m")).first().m
    assert m == "COMPANY rose; COMPANY and COMPANY fell. TICKER too, AC12 not."
    assert one.select(X.residual_names(F.col("t"), F.lit("Acme Corp Ltd")).alias("r")).first().r == ["acme", "corp"]
    assert one.select(X.alternative_mask(F.lit("COMPANY x")).alias("m")).first().m == "THE FIRM x"
    lo, hi = grading.bootstrap({str(i): np.array([float(i)]) for i in range(50)}, np.mean, 200)
    assert lo < 24.5 < hi and grading.summary_score(1, 1, {"r2": 1, "react": 1, "drift": 1}, 1)["S"] == pytest.approx(1.0)


def test_streams(spark, tmp_path):
    from tidemark.streaming.totals import streamed_daily_totals, streamed_latest

    t = datetime(2021, 1, 1, 10, tzinfo=UTC)
    rows = [("a", 1, t, 2.0), ("a", 1, t, 2.0), ("a", 2, t + timedelta(hours=1), 3.0), ("b", 3, t, None), ("a", 4, t + timedelta(days=9), 1.0)]
    df = spark.createDataFrame(rows, "k string, seq long, at timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, q, mode in (("tot", streamed_daily_totals(src(), "at", ["k"], ["k", "seq"], "v"), "update"), ("last", streamed_latest(src(), "k", "at", "seq", "v"), "update")):
        h = q.writeStream.format("memory").queryName(name).outputMode(mode).start()
        h.processAllAvailable()
        h.stop()
    assert {(r.k, r.window.start.day, r.n, r.total) for r in spark.table("tot").collect()} == {("a", 1, 2, 5.0), ("b", 1, 1, None), ("a", 10, 1, 1.0)}
    assert {(r.k, r.seq, r.value) for r in spark.table("last").collect()} == {("a", 4, 1.0), ("b", 3, None)}
