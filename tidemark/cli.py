"""Command line: build, report, test, discover, loop, demo, grade-text. Results go to stdout as JSON."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, local_session


def demo_panel(spark: SparkSession, entities: int = 60, years: int = 3, seed: int = 7):
    """Panel of the synthetic market: monthly decisions, planted and noise features, a text reading, labels, costs."""
    from datetime import date

    from tidemark.functions.text import Question, keyword_answer
    from tidemark.operators.labels import forward_returns
    from tidemark.plans.study import SourceSpec, build_panel
    from tidemark.sources.synthetic import SyntheticMarket

    m = SyntheticMarket(entities=entities, end=date(2009 + years, 12, 31), seed=seed)
    bars = cut_lineage(m.bars(spark))
    when = m.days(spark).groupBy("month").agg(F.timestamp_micros(F.unix_micros(F.max("close_at")) + F.lit(1_800_000_000)).alias("decision_time")).select("decision_time")
    uni = cut_lineage(m.names(spark).crossJoin(F.broadcast(when)))  # the grid itself is the data
    labels = cut_lineage(forward_returns(uni.select("entity_id", "decision_time"), "decision_time", bars, "entity_id", "close_at", "price", 20))
    q = Question("outlook", "scale", "How is the outlook?", (), {"0": "lowered", "2": "kept|maintained|unchanged", "4": "raised"})
    docs = m.documents(spark)
    read = cut_lineage(docs.select("entity_id", "available_at", F.lit("reader").alias("source"), F.lit("outlook").alias("feature"), keyword_answer(F.col("text"), q)["value"].alias("value"), F.xxhash64("doc_id").alias("seq")))
    p = build_panel(uni, [SourceSpec(cut_lineage(m.observations(spark))), SourceSpec(read)], labels)
    return p.withColumn("rt_cost", F.lit(0.002))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "report", "discover"):
        sub.add_parser(name).add_argument("config")
    t = sub.add_parser("test")
    t.add_argument("config")
    t.add_argument("--feature", required=True)
    t.add_argument("--transform", default="level")
    t.add_argument("--scope")
    lp = sub.add_parser("loop")
    lp.add_argument("config")
    lp.add_argument("--refits", type=int, default=6)
    d = sub.add_parser("demo")
    d.add_argument("--entities", type=int, default=60)
    d.add_argument("--years", type=int, default=3)
    g = sub.add_parser("grade-text")
    g.add_argument("answers")
    a = p.parse_args(argv)
    spark = local_session(app="tidemark")
    print(f"{a.command} ...", file=sys.stderr)
    from tidemark.plans.study import Candidate, Study

    if a.command == "demo":
        from tidemark.operators import scoring as S

        panel = demo_panel(spark, a.entities, a.years).cache()
        out = {f: S.period_t(S.rank_ic(panel, score=f), "ic").first().asDict() for f in ("planted", "noise_1", "outlook")}
    elif a.command == "grade-text":
        from tidemark.operators.grading import brier_skill

        out = brier_skill(spark.read.parquet(a.answers), "p", "y").first().asDict()
    else:
        s = Study.from_config(spark, a.config)
        if a.command == "build":
            out = {"rows": s.panel.count(), "coverage": s.coverage()}
        elif a.command == "report":
            out = s.report()
        elif a.command == "test":
            out = vars(s.test(Candidate(a.feature, a.transform, a.scope)))
        elif a.command == "discover":
            every = [c for c in s.panel.columns if c not in s.base and dict(s.panel.dtypes)[c] == "double" and c not in ("fwd_return", "rt_cost")]
            out = [vars(x) for x in s.discover([Candidate(c) for c in sorted(every)])]
        else:
            from tidemark.plans.loop import ModelConfig, replay

            rows = s.rows("tuning").where(F.col("fwd_return").isNotNull())
            times = [r.decision_time for r in rows.select("decision_time").distinct().orderBy("decision_time").collect()][-a.refits :]
            got = replay(rows, ModelConfig(tuple(s.base)), times, registry=s.registry, walk=s.walk)
            out = {"periods": got["periods"], "mean": got["mean"], "t": got["t"], "events": [vars(e) for e in got["events"]]}
    print(json.dumps({"at": datetime.now(UTC).isoformat(timespec="seconds"), "result": out}, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
