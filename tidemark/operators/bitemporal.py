"""Attributes as known at event time: bitemporal rectangles, indexed by a grid, located by event points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import DAY, time_cell
from tidemark.session import number, table

#: Width of a grid cell in days of recorded time. A key has as many cells as its history has such spans.
CELL_DAYS = 16
#: Rectangles of a key in a cell from which on the cell is halved, as often as it takes.
DENSE = 64
#: The grid of valid time: spans of 2 to the power of a level days, from FIRST_DAY on; the top level is all of it.
FIRST_DAY, TOP = -1_000_000, 22
SPAN = ("entity", "level", "place")


def valid_spans(first: Column, last: Column) -> Column:
    """Array of (level, place): the fewest spans of the grid that together are the days [first, last), null being open.

    Days are numbers since 1970-01-01, or any other unit that counts time, such as quarters.

    A span of level k at place i has the 2**k days from FIRST_DAY + i * 2**k on, so there are at most two of a level."""
    lo = F.greatest(F.coalesce(first - FIRST_DAY, F.lit(0)), F.lit(0)).cast("long")
    hi = F.least(F.coalesce(last - FIRST_DAY, F.lit(1 << TOP)), F.lit(1 << TOP)).cast("long")
    span = lambda level, place: F.struct(level.cast("int").alias("level"), place.cast("long").alias("place"))
    none = F.array().cast("array<struct<level:int,place:bigint>>")

    def rise(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        odd = lambda x: (x % 2 == 1) & (a < b)
        left = F.when(odd(a), F.array(span(level, a))).otherwise(none)
        right = F.when((b % 2 == 1) & (a + F.when(odd(a), 1).otherwise(0) < b), F.array(span(level, b - 1))).otherwise(none)
        up_a, up_b = F.floor((a + F.when(a % 2 == 1, 1).otherwise(0)) / 2), F.floor((b - F.when(b % 2 == 1, 1).otherwise(0)) / 2)
        return F.struct(up_a.cast("long").alias("a"), up_b.cast("long").alias("b"), F.concat(s["got"], left, right).alias("got"))

    start = F.struct(lo.alias("a"), hi.alias("b"), none.alias("got"))
    levels = F.sequence(F.lit(0), F.least(F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)))).cast("int"), F.lit(TOP)))  # a span is no longer than the whole
    return (
        F.when(lo >= hi, none)
        .when(hi - lo == 1, F.array(span(F.lit(0), lo)))
        .when(hi - lo == 1 << TOP, F.array(span(F.lit(TOP), F.lit(0))))
        .otherwise(F.aggregate(levels, start, rise, lambda s: s["got"]))
    )


def _day(df: DataFrame, name: str | None) -> Column:
    """Number of the day of a date or timestamp column; a column of whole numbers is taken as it is."""
    if name is None:
        return F.lit(None).cast("long")
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.col(name).cast("long") if whole else F.unix_date(F.to_date(name)).cast("long")


def known_rectangles(
    facts: DataFrame, entity: str, attribute: str, recorded: str, seq: str, value: str, days: int = CELL_DAYS,
    valid_from: str | None = None, valid_to: str | None = None,
) -> DataFrame:
    """Disjoint current-version rectangles of each (entity, attribute), cut at the grid's cells.

    A fact is known from just after `recorded` on and holds for the days [valid_from, valid_to) (without end where null,
    for all time without these columns), until a later one about those days replaces it. The days are cut into spans
    of the grid of valid time, each of which lies whole within the fact, so the facts of a span replace one another in
    order of recording: each is current in the rectangle span x (rec_from, rec_to]; rec_to is null where the cell of
    recorded time ends first (the next cell's carried rectangle goes on from there). Of facts recorded at one instant
    only the greatest seq has a rectangle. Missing values (null, NaN) have some too: they hide what was known before.
    Rows without entity, attribute or recorded, or of no day, have none.

    Columns: entity, attribute, level, place, cell, rec_from, rec_to (microseconds), seq, value (null if missing),
    halvings (of the cell, so that no part of it has many rectangles).
    """
    everywhere = F.array(F.struct(F.lit(TOP).alias("level"), F.lit(0).cast("long").alias("place")))
    spans = everywhere if valid_from is None and valid_to is None else valid_spans(_day(facts, valid_from), _day(facts, valid_to))
    f = facts.select(
        F.col(entity).alias("entity"), F.col(attribute).alias("attribute"), F.unix_micros(recorded).alias("rec_from"), F.col(seq).alias("seq"), number(F.col(value)).alias("value"), spans.alias("spans")
    ).where(F.col("entity").isNotNull() & F.col("attribute").isNotNull() & F.col("rec_from").isNotNull())
    f = f.select("entity", "attribute", F.inline("spans"), "rec_from", "seq", "value", time_cell(F.col("rec_from"), days).alias("cell"))
    f = f.repartition(*SPAN, "cell")  # what follows, and the heads of as_known, are computed where the rows then lie
    one = Window.partitionBy(*SPAN, "cell", "attribute")
    f = f.withColumn("rec_to", F.lead("rec_from").over(one.orderBy("rec_from", F.col("seq").asc_nulls_first())))
    f = f.withColumn("halvings", F.greatest(F.ceil(F.log2(F.count("*").over(one) / F.lit(DENSE))), F.lit(0)).cast("int"))
    f = f.withColumn("halvings", F.max("halvings").over(Window.partitionBy(*SPAN, "cell")))
    return f.where(F.col("rec_to").isNull() | (F.col("rec_to") > F.col("rec_from")))


def _part(t: Column, days: int) -> Column:
    """Number of the part of the (halved) cell that holds an instant."""
    width = F.lit(days * DAY)
    return F.floor((t - F.col("cell") * width) * F.pow(F.lit(2), "halvings") / width).cast("long")


def as_known(
    events: DataFrame, event_entity: str, event_time: str, facts: DataFrame, entity: str, attribute: str, recorded: str, seq: str, value: str,
    attributes: Sequence[str], event_id: str, days: int = CELL_DAYS,
    valid_at: str | None = None, valid_from: str | None = None, valid_to: str | None = None,
) -> DataFrame:
    """event_id, attribute, seq, value of the fact current just before each event, for each of the attributes.

    Current is, of the facts recorded before event_time that hold on the day valid_at (see known_rectangles; without it
    all facts hold), the one recorded last. Strict: a fact recorded at the event's instant isn't known yet. Of equal
    instants the greatest seq is current. A missing value hides older ones and comes out as a row with value null; an
    event with no fact before it gives no row. Events without entity, time or day give none; equal events give a row
    each. Extra columns play no part.

    Plan: facts are cut into rectangles within (entity, attribute, span of valid time, cell of recorded time), a hot
    entity thus over as many tasks as it has cells. A table with one row for each cell that has facts or events carries
    the last rectangle on to later cells, by a window as long as a key's cells. Events then meet the rectangles of their
    own part of a cell in an equi-join; at most one contains the point, and a part has few however dense the cell is.
    """
    known = facts.where(F.col(attribute).isin(*attributes))
    rect = known_rectangles(known, entity, attribute, recorded, seq, value, days, valid_from, valid_to)
    levels = [TOP] if valid_from is None and valid_to is None else sorted(r.level for r in rect.select("level").distinct().collect()) or [TOP]  # at most TOP + 1
    several = len(levels) > 1
    names = [f"h{i}" for i in range(len(attributes))]
    own = lambda a: F.when(F.col("attribute") == a, F.struct("rec_from", "seq"))
    heads = rect.groupBy(*SPAN, "cell").agg(*[F.max_by(F.struct("rec_from", "seq", "value"), own(a)).alias(n) for a, n in zip(attributes, names)], F.first("halvings").alias("halvings"))
    p = events.select(F.col(event_id).alias("id"), F.col(event_entity).alias("entity"), F.unix_micros(event_time).alias("t"), (F.lit(FIRST_DAY).cast("long") if valid_at is None else _day(events, valid_at)).alias("day"))
    p = p.where(F.col("entity").isNotNull() & F.col("t").isNotNull() & F.col("day").isNotNull()).withColumn("cell", time_cell(F.col("t"), days))
    if several:
        p = p.groupBy(*p.columns).agg(F.count("*").alias("copies"))
    place = lambda k: F.floor((F.col("day") - FIRST_DAY) / F.lit(1 << k)).cast("long")
    p = p.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), place(k).alias("place")) for k in levels])))

    # What holds where a cell begins, for the cells that have events; a cell's own head comes after its wanted row.
    wanted = p.select(*SPAN, "cell").distinct().withColumn("has", F.lit(0))
    both = heads.withColumn("has", F.lit(1)).unionByName(wanted, allowMissingColumns=True)
    order = Window.partitionBy(*SPAN).orderBy("cell", "has")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    same = F.lead("cell").over(order) == F.col("cell")
    cells = both.select(*SPAN, "cell", "has", *[F.last(n, True).over(before).alias(n) for n in names], F.coalesce(F.when(same, F.lead("halvings").over(order)), F.lit(0)).alias("halvings"))
    p = p.join(cells.where("has = 0").drop("has"), [*SPAN, "cell"]).withColumn("part", _part(F.col("t"), days)).drop("halvings")

    end = F.coalesce("rec_to", (F.col("cell") + 1) * F.lit(days * DAY) - 1)
    r = rect.where(F.col("rec_from") < end).select(*SPAN, "cell", "attribute", "rec_from", "rec_to", "seq", "value", F.explode(F.sequence(_part(F.col("rec_from") + 1, days), _part(end, days))).alias("part"))
    grid = [*SPAN, "cell", "part"]
    p = p.repartition(*grid).withColumn("row", F.monotonically_increasing_id()).alias("p")  # of use only within the stage that makes it
    r = r.alias("r")
    inside = (F.col("r.rec_from") < F.col("p.t")) & (F.col("r.rec_to").isNull() | (F.col("p.t") <= F.col("r.rec_to")))
    found = p.join(r, [*[F.col(f"p.{c}") == F.col(f"r.{c}") for c in grid], inside], "left")
    hits = [F.coalesce(F.max(F.when(F.col("r.attribute") == a, F.struct("r.rec_from", "r.seq", "r.value"))), F.first(f"p.{n}")) for a, n in zip(attributes, names)]
    found = found.groupBy(*[f"p.{c}" for c in grid], "p.row").agg(*[F.first(f"p.{c}").alias(c) for c in ("id", "t", "day", *(["copies"] if several else []))], *[h.alias(n) for h, n in zip(hits, names)])
    hit = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(n).alias("hit")) for a, n in zip(attributes, names)])).alias("x")
    found = found.select("entity", "id", "t", "day", *(["copies"] if several else []), hit).select("*", "x.*").where(F.col("hit").isNotNull())
    if several:  # a day lies in a span of each level; the fact recorded last counts
        found = found.groupBy("id", "entity", "t", "day", "attribute", "copies").agg(F.max_by("hit", F.struct("hit.rec_from", "hit.seq")).alias("hit"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(F.col("id").alias(event_id), "attribute", F.col("hit.seq").alias("seq"), F.col("hit.value").alias("value"))


FEATURES = ("size_log", "rev_growth", "guidance_tone")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = as_known(
        table(spark, sf_dir, "panel"), "entity_id", "decision_time", table(spark, sf_dir, "observations"), "entity_id", "feature", "available_at", "seq", "obs_value", FEATURES, "panel_id"
    )
    return got.where(F.col("value").isNotNull()).select("panel_id", F.col("attribute").alias("feature"), "seq")


def p2_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the observations that hold in the decision's quarter (about the one before, or about none), the one recorded last before it."""
    quarter = lambda c: F.year(c) * 4 + F.quarter(c)
    o = table(spark, sf_dir, "observations").select("entity_id", "feature", "available_at", "seq", "obs_value", (quarter("period_end") + 1).alias("from"), (quarter("period_end") + 2).alias("to"))
    day = F.date_from_unix_date(F.floor(F.unix_micros("decision_time") / 86_400_000_000).cast("int"))
    d = table(spark, sf_dir, "panel").select("entity_id", "decision_time", "panel_id", quarter(day).alias("at"))
    got = as_known(
        d, "entity_id", "decision_time", o, "entity_id", "feature", "available_at", "seq", "obs_value", FEATURES, "panel_id",
        valid_at="at", valid_from="from", valid_to="to",
    )
    return got.where(F.col("value").isNotNull()).select("panel_id", F.col("attribute").alias("feature"), "seq")


QUERIES = {"p2_found": p2_found, "p2_valid": p2_valid}
SQL = {
    "p2_valid": """
        WITH o AS (SELECT *, epoch_us(available_at) AS at, CASE WHEN obs_value IS NULL OR isnan(obs_value) THEN 1 ELSE 0 END AS missing FROM observations
                   WHERE feature IN ('size_log', 'rev_growth', 'guidance_tone') AND entity_id IS NOT NULL AND available_at IS NOT NULL),
        j AS (SELECT p.panel_id, o.feature, arg_max(o.seq, {'a': o.at, 's': o.seq}) AS seq, arg_max(o.missing, {'a': o.at, 's': o.seq}) AS missing
              FROM panel p JOIN o ON o.entity_id = p.entity_id AND o.available_at < p.decision_time
                   AND (o.period_end IS NULL OR year(o.period_end) * 4 + quarter(o.period_end) + 1 = year(timezone('UTC', p.decision_time)) * 4 + quarter(timezone('UTC', p.decision_time)))
              GROUP BY ALL)
        SELECT panel_id, feature, seq FROM j WHERE missing = 0""",
    "p2_found": """
        WITH o AS (SELECT entity_id, feature, available_at, max(seq) AS seq, arg_max(CASE WHEN obs_value IS NULL OR isnan(obs_value) THEN 1 ELSE 0 END, seq) AS missing
                   FROM observations WHERE feature IN ('size_log', 'rev_growth', 'guidance_tone') AND entity_id IS NOT NULL AND available_at IS NOT NULL GROUP BY ALL),
        d AS (SELECT panel_id, entity_id, decision_time, f.feature FROM panel, (VALUES ('size_log'), ('rev_growth'), ('guidance_tone')) f(feature))
        SELECT d.panel_id, d.feature, o.seq FROM d ASOF JOIN o ON d.entity_id = o.entity_id AND d.feature = o.feature AND d.decision_time > o.available_at WHERE o.missing = 0"""
}
