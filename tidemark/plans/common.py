"""Inputs that several queries share, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import number, table

DIGITS = 8
#: Added before rounding, so that values halfway between two roundings fall the same way in every engine.
OFF_TIE = 1.7e-11


def rnd(c: Column | str, d: int = DIGITS) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(OFF_TIE), d)


def rounded(df: DataFrame, d: int = DIGITS) -> DataFrame:
    """Every double rounded, -0.0 as 0.0, timestamps as microseconds, dates as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        c = F.round(c + F.lit(OFF_TIE), d) + F.lit(0.0) if kind == "double" else F.unix_micros(c) if kind == "timestamp" else c.cast("string") if kind == "date" else c.cast("bigint") if kind in ("int", "smallint") else c
        out.append(c.alias(f.name))
    return df.select(*out)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id, entity_id, decision_time, grp, score, fwd_return, rt_cost, block of the last delivery of each panel row."""
    s = table(spark, sf_dir, "scored").where(F.col("panel_id").isNotNull())
    last = F.max_by(F.struct("score", "fwd_return", "rt_cost", "block"), "score_seq")
    s = s.groupBy("panel_id").agg(last.alias("l"))
    p = table(spark, sf_dir, "panel").select("panel_id", "entity_id", "decision_time", F.coalesce("grp", F.lit("all")).alias("grp"))
    return p.join(s, "panel_id").select(*p.columns, *[number(F.col(f"l.{c}")).alias(c) for c in ("score", "fwd_return", "rt_cost")], F.col("l.block").alias("block"))


SCORED = """l AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY score_seq DESC) AS k FROM scored WHERE panel_id IS NOT NULL),
    s AS (SELECT p.panel_id, p.entity_id, p.decision_time, coalesce(p.grp, 'all') AS grp, CASE WHEN NOT isnan(l.score) THEN l.score + 0.0 END AS score,
          CASE WHEN NOT isnan(l.fwd_return) THEN l.fwd_return + 0.0 END AS fwd_return, CASE WHEN NOT isnan(l.rt_cost) THEN l.rt_cost + 0.0 END AS rt_cost, l.block
          FROM panel p JOIN l ON p.panel_id = l.panel_id AND l.k = 1)"""


def sql_pct(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END"


def r(x: str, d: int = DIGITS) -> str:
    return f"(round({x} + {OFF_TIE}, {d}) + 0.0)"


US = "epoch_us(decision_time) AS decision_time"
