"""A bent answer gets a step for each level; a straight one keeps its line."""

import random
from datetime import datetime, timedelta, timezone

from tidemark.operators import ridge
from tidemark.plans import loop

U = timezone.utc


def panel(spark, effect, seed=3):
    rnd = random.Random(seed)
    rows = []
    for p in range(24):
        t = datetime(2020, 1, 1, tzinfo=U) + timedelta(days=30 * p)
        for i in range(80):
            a, x = rnd.randrange(5), rnd.gauss(0, 1)
            rows.append((f"e{i}", t, t + timedelta(days=20), "g", float(a), x, 0.002, effect(a) + 0.01 * x + rnd.gauss(0, 0.02)))
    return spark.createDataFrame(rows, "entity_id string, decision_time timestamp, label_end timestamp, grp string, ans double, x double, rt_cost double, fwd_return double")


def last(spark, effect):
    rows = panel(spark, effect)
    c = loop.Coordinator(rows, loop.ModelConfig(("ans", "x")), loop.LoopsConfig(persist=1, cooldown=0, screen=0.0, levels=("ans",)), ridge.WalkForward("month", 10.0, 6))
    at = max(r[0] for r in rows.select("decision_time").distinct().collect()) + timedelta(days=1)
    bent = c.bent(at)
    return c, bent, bool(bent) and c.reencode(bent, at)


def test_a_bent_answer_is_stepped(spark):
    c, bent, ok = last(spark, lambda a: 0.03 * abs(a - 2))
    assert bent == ["ans"] and ok and {"ans_ge1", "ans_ge4", "x"} <= set(c.config.features) and "ans" not in c.config.features
    assert c.events[-1].kind == "judged" and c.events[-1].accepted


def test_a_straight_answer_stays(spark):
    c, bent, _ = last(spark, lambda a: 0.01 * a)
    assert c.config.features == ("ans", "x")
    assert not bent or not c.events[-1].accepted
