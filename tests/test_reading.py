"""Masking of names, the reading service and the text source."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import reading as R
from tidemark.functions.text import Question, QuestionSet
from tidemark.plans.governance import Ledger, OverBudget

U = timezone.utc


def masked(spark, text, names, ticker=None, **kw):
    df = spark.createDataFrame([(text, names, ticker)], "t string, n array<string>, k string")
    return df.select(R.mask_company(F.col("t"), F.col("n"), F.col("k"), **kw)).first()[0]


def test_masking(spark):
    m = lambda *a, **kw: masked(spark, *a, **kw)
    assert m("Zorbix Labs, Inc. said Zorbix LABS grew.", ["Zorbix", "Zorbix Labs Inc"]) == "COMPANY_A, Inc. said COMPANY_A grew."
    assert m("Exhibit 99.1Zorbix Labs Corp rose; ZBX and zbx", ["Zorbix Labs"], "ZBX") == "Exhibit 99.1COMPANY_A rose; COMPANY_A and zbx"
    assert m("zorbix and Zorbix", ["Zorbix Labs"], dictionary=["apple"]) == "COMPANY_A and COMPANY_A"
    assert m("an apple, Apple and APPLE", ["Apple Inc Fruits"], dictionary=["apple"]) == "an apple, COMPANY_A and COMPANY_A"
    assert m("national banks and National", ["National Foo"]) == "national banks and National"
    assert m("A.B (C) wins", ["A.B (C)"]) == "COMPANY_A wins"
    assert m("Fooza® with ABC-123 in FY2016. The HORIZON trial and the FDA study", []) == "PRODUCT_X® with DRUG_X in FY2016. The TRIAL_X trial and the FDA study"
    assert m("semaglutide sold", [], stems="glutide|mab") == "DRUG_X sold"
    assert m("AB co", ["AB"]) == "AB co" and m(None, ["Zorbix"]) is None and masked(spark, "x", None) == "x"


Q = QuestionSet("s", ("release",), (Question("up", "yes_no", "?", (), {"yes": "growth"}), Question("lvl", "scale", "?", (), {"0": "bad", "4": "good"})))


def docs(spark, n=6):
    t0 = datetime(2021, 1, 1, tzinfo=U)
    rows = [(i, "e" if i % 2 else "f", "release" if i != 3 else "other", f"growth is good {i % 3}", t0 + timedelta(days=i) if i else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, entity_id string, doc_type string, text string, available_at timestamp")


def test_service_reads_each_text_once(spark, tmp_path):
    s = R.ReadingService({"release": Q}, str(tmp_path / "answers"))
    d = docs(spark)
    assert s.estimate(d)["answers"] == 6  # three texts, two questions
    got = {(r.doc_id, r.question): r.value for r in s.answers(d).collect()}
    assert len(got) == 10 and got[0, "up"] == 0.9 and got[1, "lvl"] > 3
    assert s.todo(d).count() == 0 and s.answers(d).count() == 10


def test_a_paid_reader_is_guarded(spark, tmp_path):
    d = docs(spark)
    with pytest.raises(OverBudget):
        R.ReadingService({"release": Q}, str(tmp_path / "a"), usd_per_char=1.0).answers(d)
    ledger = Ledger(tmp_path / "l.csv", {"read": 10.0}, {"paid": 10.0}, {})
    with pytest.raises(OverBudget):
        R.ReadingService({"release": Q}, str(tmp_path / "b"), "paid", 1.0, ledger, "read").answers(d)
    ok = R.ReadingService({"release": Q}, str(tmp_path / "c"), "paid", 0.01, ledger, "read", chunk=2)
    assert ok.answers(d).count() == 10 and ledger.spent(step="read") == pytest.approx(0.01 * 6 * 16)


def test_text_source(spark):
    got = R.text_source(docs(spark), Q, [["entity_id"]], k=2, least=1).collect()
    assert {r.feature for r in got} == {"up", "up_chg", "up_surprise", "lvl", "lvl_chg", "lvl_surprise"} and all(r.doc_id != 0 for r in got)
    assert all(abs(r.value) < 1e-9 for r in got if r.feature == "up_chg")
