"""Top N items within every group, by histogram thresholds and an exact rank of the survivors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, fresh, number, table

#: Buckets per factor e of the score's size: 128 give edges 0.8 % apart, at most about 90,000 buckets for all doubles.
STEPS_PER_E = 128
#: Floors that are sent to every task: those of the groups they shorten most. A group without one is no larger than a
#: share of 1 / FLOORS of the rows, and is ranked as it is.
FLOORS = 10_000


def score_bucket(score: Column) -> Column:
    """A bucket number that never falls as the score rises, the same for every group and every input size."""
    size = F.least(F.log1p(F.abs(score) * F.lit(1e6)), F.lit(800.0))
    return F.floor(F.signum(score) * size * F.lit(float(STEPS_PER_E))).cast("int")


def top_n_per_group(
    df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], n: int, name: str = "top_rank"
) -> DataFrame:
    """The n rows with the highest score of each group, with their rank from 1 in column `name`.

    Order: score descending (-0.0 equals 0.0), then the tie columns ascending, nulls first; the result is the same
    every time if score and ties order a group's rows totally. A null or NaN score takes no place. A null group key
    is a group of its own. Repeated rows are separate rows. Smaller groups come out whole, an empty table gives an
    empty one. All columns of df stay; if `name` is among them it is replaced.

    Plan: a histogram per group (combined before the shuffle) gives the lowest bucket that still leaves n rows; rows
    below it are dropped where they are, by floors of which a bounded number is broadcast, so no row is shuffled to
    meet its floor and a hot group is cut down in every task that reads it. The survivors are ranked by a window whose
    row limit is applied before the shuffle, so that no task sees a group whole. df is read twice: write it first if it
    is costly.
    """
    keep = [c for c in df.columns if c.lower() != name.lower()]
    s, b, lo, cnt, cum, tot, *gs = fresh(df, "s", "b", "lo", "cnt", "cum", "tot", *[f"g{i}" for i in range(len(group))])
    rows = df.withColumn(s, number(F.col(score).cast("double"))).where(F.col(s).isNotNull()).withColumn(b, score_bucket(F.col(s)))
    hist = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(group, gs)], b).agg(F.count("*").alias(cnt))
    down = Window.partitionBy(*gs).orderBy(F.col(b).desc())
    floors = (
        hist.withColumn(cum, F.sum(cnt).over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(tot, F.sum(cnt).over(Window.partitionBy(*gs)))
        .where(F.col(cum) >= n)
        .groupBy(*gs)
        .agg(F.max(b).alias(lo), (F.first(tot) - F.min(cum)).alias(cnt))
        .where(F.col(cnt) > 0)
        .orderBy(F.col(cnt).desc())
        .limit(FLOORS)
        .drop(cnt)
    )
    on = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, gs)]
    left = rows.join(F.broadcast(floors), on, "left").where(F.col(lo).isNull() | (F.col(b) >= F.col(lo)))
    best = Window.partitionBy(*group).orderBy(F.col(s).desc(), *[F.col(t).asc() for t in ties])
    return left.withColumn(name, F.row_number().over(best)).where(F.col(name) <= n).select(*keep, name)


def latest_scores(scored: DataFrame) -> DataFrame:
    """The row of the greatest score_seq of each panel_id, even if its score is missing. Rows of no panel_id are left out."""
    last = F.max_by(F.struct("score"), "score_seq")
    return scored.where(F.col("panel_id").isNotNull()).groupBy("panel_id").agg(last["score"].alias("score"))


def ranked_panel(panel: DataFrame, scored: DataFrame, n: int = 3) -> DataFrame:
    """grp, decision_time, panel_id, score, top_rank of the first n scored rows of each (grp, decision_time)."""
    rows = panel.select("panel_id", F.coalesce("grp", F.lit("all")).alias("grp"), "decision_time")
    rows = rows.join(latest_scores(scored), "panel_id")
    return top_n_per_group(cut_lineage(rows), ["grp", "decision_time"], "score", ["panel_id"], n)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_panel(table(spark, sf_dir, "panel"), table(spark, sf_dir, "scored")).select("panel_id")


QUERIES = {"p1_found": p1_found}
SQL = {
    "p1_found": """
        WITH last AS (SELECT panel_id, score, row_number() OVER (PARTITION BY panel_id ORDER BY score_seq DESC) k FROM scored WHERE panel_id IS NOT NULL),
        r AS (SELECT p.panel_id, row_number() OVER (PARTITION BY coalesce(p.grp, 'all'), p.decision_time ORDER BY s.score + 0.0 DESC, p.panel_id) rk
              FROM panel p JOIN last s ON p.panel_id = s.panel_id AND s.k = 1 WHERE s.score IS NOT NULL AND NOT isnan(s.score))
        SELECT panel_id FROM r WHERE rk <= 3"""
}
