"""Phrase splitting, column labels and the synthetic evaluation sets."""

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidemark.functions.text import Question, QuestionSet, keyword_answer
from tidemark.operators import grading as G
from tidemark.plans import splitter as S
from tidemark.sources.synthetic import SyntheticMarket

U = timezone.utc
T0 = datetime(2021, 1, 1, tzinfo=U)


def test_a_phrase_is_found_asked_and_read(spark):
    rows = [(f"e{i}", T0 + timedelta(days=10), float(i % 10 >= 7), (1.0 if i % 10 == 9 else -1.0) + i / 1e4) for i in range(200)]
    frame = spark.createDataFrame(rows, "entity_id string, decision_time timestamp, x double, resid double")
    docs = [(i, f"e{i}", T0, ("The company will halt its plant soon." if i % 10 == 9 else "Orders were as usual this year.") + f" Note {i}.") for i in range(200)]
    docs += [(1000, "e9", T0 + timedelta(days=10), "too late to know"), (1001, "e9", None, "no stamp")]
    docs = spark.createDataFrame(docs, "doc_id long, entity_id string, available_at timestamp, text string")
    got = S.documents_behind(frame, docs, "x", top=20, rest=10)
    assert got.where("top").count() == 20 and got.where("top and text like '%halt%'").count() == 20 and got.where("not top").count() == 10
    sp = S.PhraseSplitter(docs, least_lift=0.3, most=1)
    frame_top = frame.where("x = 1")
    assert S.documents_behind(frame_top.limit(0), docs, "x").count() == 0
    import functools

    S.documents_behind, keep = functools.partial(S.documents_behind, top=20, rest=40), S.documents_behind
    try:
        q = sp.propose(frame, "x", "outlook")
    finally:
        S.documents_behind = keep
    assert q.id == "outlook_phrase1" and sp.splits[0]["lift"] > 0.9 and "company" not in sp.splits[0]["phrase"]
    read = {r.entity_id: r[q.id] for r in sp.read(frame, q).collect()}
    assert all((read[f"e{i}"] == 0.9) == (i % 10 == 9) for i in range(200))
    assert sp.propose(frame, "x", "outlook") is None


def test_columns_and_labels():
    cols = S.question_columns(QuestionSet("s", ("d",), (Question("up", "yes_no", "Is it up?", (), {"yes": "u"}),)), "t_")
    assert cols["t_up_chg"] == {"question": "up", "kind": "yes_no", "part": "p", "encoding": "change", "wording": "Is it up?", "tag": "reading"}
    assert S.column_labels(cols, {"t_up": "own"})["t_up"] == "own" and "base rate" in S.column_labels(cols)["t_up_surprise"]


def test_synthetic_evaluation_sets(spark):
    m = SyntheticMarket(entities=12, end=date(2010, 12, 31))
    q = Question("outlook", "choice", "?", ("raised", "lowered", "kept"), {"raised": "raised", "lowered": "lowered", "kept": "kept|maintained"}, "kept")
    gold = m.gold(spark).join(m.documents(spark).select("doc_id", "text"), "doc_id").withColumn("p", keyword_answer(F.col("text"), q)["probs"])
    assert gold.where(F.col("p")[F.col("outlook")] < 0.9).count() == 0 and gold.count() == 12 * 12
    p = m.probes(spark).withColumns({"a": keyword_answer(F.col("text"), q)["probs"], "b": keyword_answer(F.col("probe_text"), q)["probs"]})
    share = {r.probe: r.share for r in G.invariance(p.withColumn("held", G.stable_choice(F.col("a"), F.col("b"))), "held", ["probe"]).collect()}
    assert share["paraphrase"] == share["order"] == share["mask_alt"] == 1.0 and 0 < share["counterfactual"] < 0.6
    e = m.market_set(spark)
    assert 0 < e.count() < 12 * 12 and e.where("z is null or drift is null").count() == 0
