"""As-of joins: strict or inclusive, backward or forward, with staleness, by union and window; nearest and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import DAY, carried, equal_keys, time_cell

#: Days of a cell of time.
CELL_DAYS = 32


def asof(
    left: DataFrame, left_time: str, right: DataFrame, right_time: str, keys: Sequence[str], seq: str, values: Sequence[str],
    inclusive: bool = False, forward: bool = False, max_age_days: float | None = None, provenance: str = "known_at",
) -> DataFrame:
    """left with `values` and `provenance` of the nearest right row of its keys: before it, or after it with forward.

    Strict unless inclusive. Of right rows at one instant the greatest seq counts (the least, forward). A null value
    masks older ones: the row still counts as found. With max_age_days a row too old gives nulls. Keys join null-safe
    as groups.

    Plan: one shuffle of both sides by keys and cell of time, so a hot key is as many tasks as it has cells; what a
    cell begins with comes from a table of one row a cell.
    """
    names = [c for c in left.columns if c not in (*values, provenance)]
    pair = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    side = 1 if inclusive == forward else 0  # where right rows stand among left rows of the same instant
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.unix_micros(right_time).alias("__t"), F.lit(side).alias("__side"), F.col(seq).cast("long").alias("__seq"), pair.alias("__hit"))
    kind = r.schema["__hit"].dataType
    l = left.select(*keys, F.unix_micros(left_time).alias("__t"), F.lit(1 - side).alias("__side"), F.lit(None).cast("long").alias("__seq"), F.lit(None).cast(kind).alias("__hit"), F.struct(*names).alias("__left"))  # noqa: E741
    both = r.withColumn("__left", F.lit(None).cast(l.schema["__left"].dataType)).unionByName(l).withColumn("__cell", F.coalesce(time_cell(F.col("__t"), CELL_DAYS), F.lit(-(1 << 62))))
    order = ["__t", "__side", "__seq"]
    w = Window.partitionBy(*keys, "__cell").orderBy(*[F.col(c).desc() if forward else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("__hit").isNotNull(), F.struct("__t", "__seq"))
    edge = carried(both, keys, "__cell", [(F.min_by if forward else F.max_by)("__hit", at)], ["__edge"], forward).alias("__e")
    got = both.withColumn("__hit", F.last("__hit", True).over(w)).where(F.col("__left").isNotNull()).alias("__b")
    got = got.join(edge, equal_keys("__b", "__e", [*keys, "__cell"]), "left")
    got = got.select("__b.__left", "__b.__t", F.coalesce("__b.__hit", F.when(F.col("__b.__t").isNotNull(), F.col("__e.__edge"))).alias("__hit"))
    if max_age_days is not None:
        age = F.abs(F.col("__t") - F.unix_micros("__hit.t"))
        got = got.withColumn("__hit", F.when(age <= int(max_age_days * DAY), F.col("__hit")))
    return got.select("__left.*", *[F.col(f"__hit.{v}").alias(v) for v in values], F.col("__hit.t").alias(provenance))


def attach(
    panel: DataFrame, entity: str, time: str, obs: DataFrame, feature: str, value: str, known: str, seq: str, features: Sequence[str], max_age_days: float | None = None,
) -> DataFrame:
    """panel with x_<f> and at_<f> of each feature: all features in one strict as-of pass.

    Plan: as asof, by entity and cell of time."""
    o = obs.where(F.col(feature).isin(*features) & F.col(known).isNotNull())
    side = o.select(F.col(entity), F.unix_micros(known).alias("__t"), F.lit(1).alias("__side"), F.col(seq).alias("__seq"), F.col(feature).alias("__f"), F.struct(F.col(known).alias("at"), F.col(value).alias("x")).alias("__o"))
    p = panel.select(entity, F.unix_micros(time).alias("__t"), F.lit(0).alias("__side"), F.struct(*panel.columns).alias("__p"))
    both = side.unionByName(p, allowMissingColumns=True).withColumn("__cell", F.coalesce(time_cell(F.col("__t"), CELL_DAYS), F.lit(-(1 << 62))))
    w = Window.partitionBy(entity, "__cell").orderBy("__t", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda f: F.when(F.col("__f") == f, F.col("__o"))
    names = [f"__h{i}" for i in range(len(features))]
    edge = carried(both, [entity], "__cell", [F.max_by(own(f), F.when(F.col("__f") == f, F.struct("__t", "__seq"))) for f in features], names).alias("__e")
    got = both.select(entity, "__cell", "__t", "__p", *[F.last(own(f), True).over(w).alias(n) for f, n in zip(features, names)]).where(F.col("__p").isNotNull()).alias("__b")
    got = got.join(edge, equal_keys("__b", "__e", [entity, "__cell"]), "left")
    out = [F.col("__b.__p.*")]
    for f, n in zip(features, names):
        h = F.coalesce(f"__b.{n}", F.when(F.col("__b.__t").isNotNull(), F.col(f"__e.{n}")))
        if max_age_days is not None:
            h = F.when(F.col("__b.__t") - F.unix_micros(h["at"]) <= int(max_age_days * DAY), h)
        out += [h["x"].alias(f"x_{f}"), h["at"].alias(f"at_{f}")]
    return got.select(*out)


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, lag_days: int, within: int, value: str, out: str) -> DataFrame:
    """left with `out`: value of the right row nearest to lag_days before it, within so many days; first on a tie.

    Dates are cut into spans of the tolerance, so the join is on equal keys and span."""
    span = 2 * within + 1
    target = F.date_sub(F.col(left_date), lag_days)
    l = left.withColumn("__target", target).withColumn("__cell", F.explode(F.array_distinct(F.array(F.floor(F.datediff(F.date_sub("__target", within), F.lit("1970-01-01").cast("date")) / span), F.floor(F.datediff(F.date_add("__target", within), F.lit("1970-01-01").cast("date")) / span)))))  # noqa: E741
    r = right.select(*keys, F.col(right_date).alias("__d"), F.col(value).alias("__v")).where(F.col("__d").isNotNull()).withColumn("__cell", F.floor(F.datediff("__d", F.lit("1970-01-01").cast("date")) / span))
    gap = F.abs(F.datediff("__d", "__target"))
    best = l.join(r, [*keys, "__cell"]).where(gap <= within).groupBy(*keys, left_date).agg(F.min_by("__v", F.struct(gap, F.col("__d"), F.col("__v"))).alias(out))
    return left.join(best, [*keys, left_date], "left")


def in_window(points: DataFrame, point_time: str, events: DataFrame, event_time: str, keys: Sequence[str], days: int, aggs: Sequence[Column], point_id: str) -> DataFrame:
    """point_id and aggregates over the events of its keys in the open window (t - days, t); empty windows too.

    Any aggregate is allowed. Events are matched by span of `days`, each point meeting two spans."""
    t = F.unix_micros(point_time)
    cell = lambda c: F.floor(c / F.lit(days * DAY))
    p = points.select(point_id, *keys, t.alias("__t")).withColumn("__cell", F.explode(F.array(cell(F.col("__t")), cell(F.col("__t")) - 1)))
    e = events.withColumn("__e", F.unix_micros(event_time)).withColumn("__cell", cell(F.col("__e"))).where(F.col("__e").isNotNull())
    hit = p.join(e, [*keys, "__cell"]).where((F.col("__e") < F.col("__t")) & (F.col("__e") > F.col("__t") - days * DAY))
    return points.select(point_id).join(hit.groupBy(point_id).agg(*aggs), point_id, "left")
