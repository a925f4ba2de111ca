"""Mixed timestamp spellings and zones to one UTC instant, by an as-of join on exploded zone-offset intervals."""

from __future__ import annotations

import functools
import zoneinfo
from collections.abc import Iterable
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import fresh, held, table

DAY = 86_400_000_000
#: Years whose offset intervals are tabled. No zone changed its offset before them, so the first interval has no
#: beginning; after them each year is as the one of the last 28 that starts on its weekday and is as long (zones' rules
#: for the future go by weekdays, and 2101 to 2128 hold every kind of year).
FIRST_YEAR, LAST_YEAR = 1840, 2128

#: The fixed meaning of zone abbreviations, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180, "NST": -210, "NDT": -150,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540,
}

_MON = r"(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEPT?(?:EMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)\.?"
_WEEKDAY = r"(?:(?:MON|TUE|TUES|WED|THU|THUR|THURS|FRI|SAT|SUN|MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY)\.?,?\s+)?"
_ZONE = r"(?:" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r"|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)"
#: year, month (number or name), day, hour, minute, second, fraction, AM or PM, zone, [region]
_MASTER = (
    r"^(\d{4})-(\d{1,2}|" + _MON + r")-(\d{1,2})(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AP])\.?M\.?)?)?"
    r"(?:\s*(" + _ZONE + r"))?(?:\s*\[([A-Z0-9_+/-]+)\])?$"
)


@functools.cache
def zone_intervals(tz: str) -> tuple[tuple[int | None, int, int, int], ...]:
    """(local_from, local_to, utc_from, offset) in microseconds of each span of constant offset of a zone.

    The spans cover FIRST_YEAR to LAST_YEAR, the first one everything before too (local_from null); found by weekly
    steps and bisection in the zone's own rules, once a process."""
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    micros = lambda d: (d - epoch) // timedelta(microseconds=1)
    zone = zoneinfo.ZoneInfo(tz)
    off = lambda d: d.astimezone(zone).utcoffset()
    start, last = datetime(FIRST_YEAR, 1, 1, tzinfo=UTC) - timedelta(days=2), datetime(LAST_YEAR, 12, 31, tzinfo=UTC) + timedelta(days=2)
    t, o, out = start, off(start), []
    while t < last:
        u = min(t + timedelta(days=7), last)
        if off(u) == o:
            t = u
            continue
        lo, hi = t, u
        while hi - lo > timedelta(seconds=1):
            mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
            lo, hi = (mid, hi) if off(mid) == o else (lo, mid)
        out.append((micros(start + o) if out else None, micros(hi + o), micros(start), o // timedelta(microseconds=1)))
        start, t, o = hi, hi, off(hi)
    return (*out, (micros(start + o) if out else None, micros(last + o), micros(start), o // timedelta(microseconds=1)))


def interval_table(spark: SparkSession, zones: Iterable[str]) -> DataFrame:
    """zone (upper case), year, spans: of every local year the intervals that touch it, exploded onto it.

    One row for each zone and year, so its size is bounded by the zones that exist (about 600) times 289 years.
    """
    by: dict[tuple[str, int], list] = {}
    year_of = lambda x: (datetime(1970, 1, 1) + timedelta(microseconds=x)).year
    for tz in sorted(set(zones)):
        for a, b, u, o in zone_intervals(tz):
            first = FIRST_YEAR if a is None else max(year_of(a - 2 * DAY), FIRST_YEAR)
            for y in range(first, min(year_of(b + 2 * DAY), LAST_YEAR) + 1):
                by.setdefault((tz.upper(), y), []).append((-(1 << 62) if a is None else a, b, u, o))
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi", "utc", "off")])
    schema = T.StructType([T.StructField("zone", T.StringType()), T.StructField("year", T.LongType()), T.StructField("spans", T.ArrayType(span))])
    return spark.createDataFrame([(z, y, v) for (z, y), v in by.items()], schema)


def _tabled(local: Column) -> tuple[Column, Column]:
    """Of a local time the tabled year whose intervals hold for it, and the microseconds from that year to its own."""
    year = F.year(F.date_from_unix_date(F.floor(local / F.lit(DAY)).cast("int"))).cast("long")
    starts = {(date(y, 1, 1).isoweekday() % 7 + 1, y % 4 == 0): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    first_day = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    kind = F.dayofweek(first_day) * 2 + F.when(leap, 1).otherwise(0)
    alike = F.create_map(*[F.lit(x) for (w, lp), y in starts.items() for x in (w * 2 + lp, y)])[kind]
    days = F.datediff(first_day, F.make_date(alike.cast("int"), F.lit(1), F.lit(1))).cast("long")
    late = year > LAST_YEAR
    return F.when(late, alike.cast("long")).otherwise(F.greatest(year, F.lit(FIRST_YEAR).cast("long"))), F.when(late, days * F.lit(DAY)).otherwise(F.lit(0).cast("long"))


def parse_stamps(df: DataFrame, raw: str) -> DataFrame:
    """df with a struct `parsed`: local (micros of the wall clock, or of the instant if offset is set), offset (micros
    east of UTC, null if the text names none), region (of a bracket, upper case). Null where the text is unreadable."""
    s = F.upper(F.regexp_replace(F.col(raw), r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", "$3-$1-$2")
    s = F.regexp_replace(s, "^" + _WEEKDAY + r"(\d{1,2})[ -](" + _MON + r")[ -](\d{4})(?!\d)", "$3-$2-$1")
    s = F.regexp_replace(s, "^" + _WEEKDAY + "(" + _MON + r") (\d{1,2}), ?(\d{4})(?!\d)", "$3-$1-$2")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})?$", "$1-$2-$3T$4:$5:$6.$7")
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}T)(\d{2})(\d{2})(\d{2})?(?=[^:\d]|$)", "$1$2:$3:$4")
    s = F.regexp_replace(F.regexp_replace(s, r":(?=$|[^\d])", ""), r"\.(?=$)", "")
    text, parts, out, read, done = fresh(df, "s", "parts", "out", "read", "done")
    df = held(df, text, s)
    t = F.col(text)
    df = held(df, parts, F.when(t.rlike(_MASTER), F.split(F.regexp_replace(t, _MASTER, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), r"\|")))
    fields = ("year", "mon", "day", "hour", "minute", "second", "frac", "half", "zone", "region")
    text_of = {n: F.col(f"{out}.{n}") for n in fields}
    df = df.withColumn(out, F.when(F.col(parts).isNotNull(), F.struct(*[F.col(parts)[i].alias(n) for i, n in enumerate(fields)])))
    number_of = lambda n: text_of[n].try_cast("int")
    month = F.coalesce(number_of("mon"), (F.floor(F.instr(F.lit("JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"), F.substring(text_of["mon"], 1, 3)) / 3) + 1).cast("int"))
    half = text_of["half"]
    hour = F.when(half == "", number_of("hour")).when(number_of("hour").between(1, 12), number_of("hour") % 12 + F.when(half == "P", 12).otherwise(0))
    digits = F.regexp_replace(F.regexp_replace(text_of["zone"], "^(?:UTC|GMT)(?=[+-])", ""), ":", "")
    df = held(
        df,
        read,
        F.when(
            F.col(out).isNotNull(),
            F.struct(
                number_of("year").alias("year"), month.alias("mon"), number_of("day").alias("day"), (text_of["hour"] == "").alias("alone"),
                hour.alias("hour"), number_of("minute").alias("minute"), F.coalesce(number_of("second"), F.lit(0)).alias("second"),
                F.coalesce(F.rpad(F.substring(text_of["frac"], 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("frac"),
                text_of["zone"].alias("zone"), digits.alias("digits"), text_of["region"].alias("region"),
            ),
        ),
    )
    c = lambda n: F.col(f"{read}.{n}")
    leap = ((c("year") % 4 == 0) & (c("year") % 100 != 0)) | (c("year") % 400 == 0)
    longest = F.when(c("mon").isin(4, 6, 9, 11), 30).when((c("mon") == 2) & leap, 29).when(c("mon") == 2, 28).otherwise(31)
    dated = c("year").between(1, 9999) & c("mon").between(1, 12) & c("day").between(1, longest)
    midnight = F.when(dated, F.unix_date(F.make_date(c("year"), c("mon"), c("day"))).cast("long") * F.lit(DAY))
    fine = c("hour").between(0, 23) & c("minute").between(0, 59) & c("second").between(0, 59)
    clock = F.when(c("alone"), F.lit(DAY)).when(fine, (c("hour") * 3600 + c("minute") * 60 + c("second")).cast("long") * F.lit(1_000_000) + c("frac"))
    bare = F.regexp_replace(c("digits"), "^[+-]", "")
    bare = F.when(F.length(bare) <= 2, F.concat(F.lpad(bare, 2, "0"), F.lit("00"))).otherwise(F.lpad(bare, 4, "0"))
    hm = [F.substring(bare, i, 2).try_cast("int") for i in (1, 3)]
    shift = F.when((hm[0] <= 18) & (hm[1] <= 59), (hm[0] * 60 + hm[1]) * F.when(c("digits").startswith("-"), -1).otherwise(1))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[c("zone")]
    minutes = F.when(c("digits").rlike("^[+-]"), shift).otherwise(named)
    df = held(df, done, F.struct((midnight + clock).alias("local"), (minutes.cast("long") * F.lit(60_000_000)).alias("offset"), c("zone").alias("zone"), F.nullif(c("region"), F.lit("")).alias("region")))
    q = lambda n: F.col(f"{done}.{n}")
    good = q("local").isNotNull() & ((q("zone") == "") | q("offset").isNotNull())
    unix = t.rlike(r"^(\d{9,10}|\d{13})$")
    epoch = t.try_cast("long") * F.when(F.length(t) == 13, F.lit(1000)).otherwise(F.lit(1_000_000))
    result = lambda a, b, r: F.struct(a.alias("local"), b.cast("long").alias("offset"), r.cast("string").alias("region"))
    parsed = F.when(unix, result(epoch, F.lit(0), F.lit(None))).when(good, result(q("local"), q("offset"), q("region")))
    return held(df.drop("parsed"), "parsed", parsed).drop(text, parts, out, read, done)


def to_instants(stamps: DataFrame, raw: str, calendars: DataFrame, calendar_id: str = "calendar_id") -> DataFrame:
    """stamps with utc_micros: the one instant each text names, null where it is unreadable or names none.

    A zone, offset or abbreviation in the text decides (an offset before a bracketed region); without one the text is
    local time in its calendar's tz, and unreadable if the calendar or its tz is unknown. A date alone is the next
    midnight. A local time matched by two offset intervals is the later instant, by none the end of the gap, by one
    that offset, in any year from 1 to 9999. Finer digits than microseconds are cut off. Null, blank, unreadable and impossible texts give null.
    A column utc_micros or parsed of the input is replaced; calendars hold each id once.
    """
    spark = stamps.sparkSession
    known = {z.upper(): z for z in zoneinfo.available_timezones()}
    cal = calendars.select(F.col(calendar_id).alias("__cal"), F.upper("tz").alias("__tz")).where(F.col("__cal").isNotNull()).dropDuplicates(["__cal"])
    p = parse_stamps(stamps, raw)
    named = p.where(F.col(raw).contains("[")).select(F.col("parsed.region").alias("z")).union(cal.select("__tz")).where(F.col("z").isin(*known)).distinct()
    zones = [known[r.z] for r in named.collect()]  # at most the zones that exist
    spans = interval_table(spark, zones or ["UTC"])
    p = p.join(F.broadcast(cal), p[calendar_id] == cal["__cal"], "left")
    zone = F.coalesce("parsed.region", "__tz")
    p = p.withColumn("__zone", F.when(F.col("parsed").isNotNull() & F.col("parsed.offset").isNull(), zone))
    year, ahead = _tabled(F.col("parsed.local"))
    p = held(p, "__in", F.when(F.col("__zone").isNotNull(), F.struct(year.alias("year"), ahead.alias("ahead"))))
    p = p.withColumn("__year", F.col("__in.year"))
    spans = spans.select(F.col("zone").alias("__z"), F.col("year").alias("__y"), "spans")
    p = p.join(F.broadcast(spans), (F.col("__zone") == F.col("__z")) & (F.col("__year") == F.col("__y")), "left")  # one row a zone and year
    local = F.col("parsed.local") - F.col("__in.ahead")
    hits = F.filter("spans", lambda x: (x["lo"] <= local) & (local < x["hi"]))
    later = F.array_max(F.transform(hits, lambda x: local - x["off"]))
    gap_end = F.array_min(F.transform(F.filter("spans", lambda x: x["lo"] > local), lambda x: x["utc"]))
    utc = F.when(F.col("parsed.offset").isNotNull(), F.col("parsed.local") - F.col("parsed.offset")).when(F.col("spans").isNotNull(), F.coalesce(later, gap_end) + F.col("__in.ahead"))
    names = [c for c in stamps.columns if c.lower() not in ("utc_micros", "parsed")]
    return held(p.drop("utc_micros"), "utc_micros", utc).select(*names, "utc_micros")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = to_instants(table(spark, sf_dir, "raw_stamps").select("stamp_id", "calendar_id", "raw_stamp"), "raw_stamp", table(spark, sf_dir, "calendars"))
    return got.where(F.col("utc_micros").isNotNull()).select("stamp_id", "utc_micros")


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
