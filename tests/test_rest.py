"""Helpers that no query calls: spot checks, overrides, quality, tails, sizes, trees, and the guard of the checkpoint folder."""

from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import grading as G
from tidemark.operators import prices as P
from tidemark.operators import windows as V

U = timezone.utc


def test_spot_checks_and_overrides(spark):
    d = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)] + [(99, None)], "id long, odd boolean")
    got = G.spotcheck(d, "id", F.col("odd"), plain=5, marked=4).collect()
    assert sum(r.flagged for r in got) == 4 and len(got) == 9 and {r.id for r in got} == {r.id for r in G.spotcheck(d, "id", F.col("odd"), 5, 4).collect()}
    fixed = G.with_overrides(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), spark.createDataFrame([(2, "b"), (2, "b"), (3, "c")], "k long, v string"), ["k"], "v")
    assert {r.k: r.v for r in fixed.collect()} == {1: "a", 2: "b"}


def test_quality_tails_and_bars(spark):
    d = spark.createDataFrame([(0.9, 0.5, 0.3), (0.7, 0.5, 0.3), (0.9, 0.2, 0.3), (0.9, 0.5, 0.1)], "a double, b double, c double")
    assert [r[0] for r in d.select(G.reading_quality(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["fine", "poor", "poor", "poor"]
    assert [r.a for r in V.tail(spark.createDataFrame([(k,) for k in range(9)], "a int"), "a", 2).collect()] == [8, 7]
    assert P.positive_bars(spark.createDataFrame([(1.0, 1), (0.0, 1), (1.0, 0), (None, 1)], "p double, v int"), "p", "v").count() == 1


def test_choices_agree_by_total_variation(spark):
    d = spark.createDataFrame([({"a": 0.9, "b": 0.1}, {"a": 0.85, "b": 0.15}), ({"a": 0.9, "b": 0.1}, {"a": 0.7, "b": 0.3}), ({"a": 1.0}, {"b": 1.0})], "x map<string,double>, y map<string,double>")
    assert [r[0] for r in d.select(G.stable_choice(F.col("x"), F.col("y"))).collect()] == [True, False, False]


@pytest.mark.parametrize(("master", "refused"), [("local[*]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_an_unset_checkpoint_folder_is_refused_off_local(master, refused):
    named = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: named[-1] if named else None, setCheckpointDir=named.append)
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    if refused:
        with pytest.raises(RuntimeError):
            session.shared_checkpoint_dir(spark)
    else:
        assert session.shared_checkpoint_dir(spark) == named[0]
    spark.conf = SimpleNamespace(get=lambda k, d=None: "hdfs://shared")
    named.clear()
    assert session.shared_checkpoint_dir(spark) == "hdfs://shared"


def test_trees_learn_what_had_closed(spark):
    import random

    from tidemark.operators.trees import walk_forward_trees

    rnd = random.Random(1)
    at = lambda y, m: datetime(y, m, 1, tzinfo=U)
    rows = [(at(y, m), at(y, m + 1), x, float(x > 0) - 0.5) for y in (2020, 2021) for m in range(1, 12) for x in [rnd.uniform(-1, 1) for _ in range(20)]]
    df = spark.createDataFrame(rows, "t timestamp, e timestamp, x double, y double")
    got = walk_forward_trees(df, ["x"], "y", "t", "e", [(at(2020, 1), at(2021, 1)), (at(2021, 1), at(2022, 1))], trees=3).collect()
    assert len(got) == 220 and sum((r.score > 0) == (r.x > 0) for r in got) > 210
