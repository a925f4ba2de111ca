"""Totals over trailing periods of calendar days, by exploding each daily total onto the days it influences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import local_date, table, trimmed


def trailing_totals(daily: DataFrame, keys: Sequence[str], day: str, value: str, periods: Sequence[int] = (7, 30), zeros: bool = False) -> DataFrame:
    """keys, day, n<p> (total of the p days ending with day) and avg<p> (n<p> / p) of each period p.

    `daily` may hold several rows a key and day; they are added up (nulls and NaN count as 0). Rows without a day are
    left out; a null key is a key of its own. Days: those with a nonzero window, that is from each total to the
    longest period after it. With zeros=True, every calendar day from a key's first day to the last day on which any
    of its totals counts comes out, days of empty windows as 0.

    Plan: one shuffle by (keys, day) for the daily totals, combined before it; one by keys of these totals (a key has
    one row a day at most, so none is hot). The exploded rows are grouped in place, and the calendar rows of empty
    windows are joined in where they belong, between a key's neighbouring days, so neither needs another shuffle and the
    calendar, which may be many times the events, is neither sorted nor grouped.
    """
    keys, longest = list(keys), max(periods)
    tot = daily.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).cast("date").alias(day))
    tot = tot.agg(F.sum(F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("__v"))
    tot = tot.repartition(*keys)
    hit = tot.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn(day, F.date_add(day, F.col("__k")))
    sums = [F.sum(F.when(F.col("__k") < p, F.col("__v")).otherwise(0.0)).alias(f"n{p}") for p in periods]
    out = hit.groupBy(*keys, day).agg(*sums)
    if zeros:
        gap = F.datediff(F.lead(day).over(Window.partitionBy(*keys).orderBy(day)), F.col(day))
        out = out.withColumn("__gap", F.coalesce(gap - 1, F.lit(0)))
        out = out.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__gap"))))
        out = out.select(*keys, F.date_add(day, F.col("__k")).alias(day), *[F.when(F.col("__k") == 0, F.col(f"n{p}")).otherwise(0.0).alias(f"n{p}") for p in periods])
    return out.select(*keys, day, *[f"n{p}" for p in periods], *[(F.col(f"n{p}") / F.lit(float(p))).alias(f"avg{p}") for p in periods])


def cik_of(entity: str):
    """The bigint key of any spelling: outer blanks, a CIK prefix and leading zeros mean nothing; else null."""
    return F.expr("try_cast(nullif(regexp_extract(__e, '(?i)^(?:CIK)?[ :#-]*([0-9]{1,18})$', 1), '') as bigint)".replace("__e", entity))


def daily_filings(events: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """cik, category, event_day, filings: each filing once per category, on the local day it was published.

    Rows without category, published_at or a readable cik don't count; a filing without accession is told apart by
    event_id. Delivered again with another stamp, the earliest counts.
    """
    e = events.select(
        trimmed(F.col("entity")).alias("entity"), "category", "published_at", F.coalesce("accession", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("filing")
    ).withColumn("cik", cik_of("entity"))
    e = e.where(F.col("cik").isNotNull() & F.col("category").isNotNull() & F.col("published_at").isNotNull())
    once = e.groupBy("cik", "category", "filing").agg(F.min("published_at").alias("published_at"))
    return once.groupBy("cik", "category", local_date(F.col("published_at"), tz).alias("event_day")).agg(F.count("*").alias("filings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trailing_totals(daily_filings(table(spark, sf_dir, "eight_k_events")), ["cik", "category"], "event_day", "filings")
    got = got.where((F.col("n7") >= 3) & (10 * F.col("n7") >= 7 * F.col("n30")))
    return got.select("cik", "category", F.date_format("event_day", "yyyy-MM-dd").alias("event_day"))


def daily_observations(observations: DataFrame, tz: str = "America/New_York") -> DataFrame:
    """entity_id, obs_day, observations: rows delivered on each local day. Rows without entity or available_at don't count."""
    o = observations.where(F.col("entity_id").isNotNull() & F.col("available_at").isNotNull())
    return o.groupBy("entity_id", local_date(F.col("available_at"), tz).alias("obs_day")).agg(F.count("*").alias("observations"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trailing_totals(daily_filings(table(spark, sf_dir, "eight_k_events")), ["cik", "category"], "event_day", "filings", zeros=True)
    return got.withColumn("event_day", F.date_format("event_day", "yyyy-MM-dd"))


def p4_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trailing_totals(daily_observations(table(spark, sf_dir, "observations")), ["entity_id"], "obs_day", "observations", zeros=True)
    return got.withColumn("obs_day", F.date_format("obs_day", "yyyy-MM-dd"))


_TRAILING = lambda keys, day: f"""c AS (SELECT {keys}, CAST(unnest(generate_series(min(d), max(d) + 29, INTERVAL 1 DAY)) AS DATE) AS d FROM n GROUP BY {keys}),
        w AS (SELECT {keys}, d, coalesce(n.n, 0) AS n FROM c LEFT JOIN n USING ({keys}, d)),
        t AS (SELECT {keys}, d, sum(n) OVER (PARTITION BY {keys} ORDER BY d ROWS 6 PRECEDING) AS n7, sum(n) OVER (PARTITION BY {keys} ORDER BY d ROWS 29 PRECEDING) AS n30 FROM w)
        SELECT {keys}, strftime(d, '%Y-%m-%d') AS {day}, CAST(n7 AS DOUBLE) AS n7, CAST(n30 AS DOUBLE) AS n30, n7 / CAST(7 AS DOUBLE) AS avg7, n30 / CAST(30 AS DOUBLE) AS avg30 FROM t"""  # noqa: E731
QUERIES = {"p4_found": p4_found, "p4_totals": p4_totals, "p4_observations": p4_observations}
SQL = {
    "p4_found": """
        WITH f AS (SELECT DISTINCT CAST(regexp_extract(trim(entity), '([0-9]+)$', 1) AS BIGINT) AS cik, category, accession, CAST(timezone('America/New_York', published_at) AS DATE) AS d
                   FROM eight_k_events WHERE category IS NOT NULL AND published_at IS NOT NULL),
        n AS (SELECT cik, category, d, count(*) AS n FROM f GROUP BY ALL),
        x AS (SELECT DISTINCT cik, category, d + CAST(k AS INTEGER) AS d FROM n, range(0, 30) r(k)),
        w AS (SELECT x.cik, x.category, x.d, sum(CASE WHEN n.d > x.d - 7 THEN n.n ELSE 0 END) AS n7, sum(n.n) AS n30
              FROM x JOIN n ON x.cik = n.cik AND x.category = n.category AND n.d <= x.d AND n.d > x.d - 30 GROUP BY ALL)
        SELECT cik, category, strftime(d, '%Y-%m-%d') AS event_day FROM w WHERE n7 >= 3 AND 10 * n7 >= 7 * n30""",
    "p4_totals": f"""
        WITH f AS (SELECT CAST(regexp_extract(trim(entity), '([0-9]+)$', 1) AS BIGINT) AS cik, category, coalesce(accession, 'event ' || event_id) AS filing, min(published_at) AS first_at
                   FROM eight_k_events WHERE category IS NOT NULL AND published_at IS NOT NULL GROUP BY ALL),
        n AS (SELECT cik, category, CAST(timezone('America/New_York', first_at) AS DATE) AS d, count(*) AS n FROM f GROUP BY ALL), {_TRAILING("cik, category", "event_day")}""",
    "p4_observations": f"""
        WITH n AS (SELECT entity_id, CAST(timezone('America/New_York', available_at) AS DATE) AS d, count(*) AS n FROM observations WHERE entity_id IS NOT NULL AND available_at IS NOT NULL GROUP BY ALL),
        {_TRAILING("entity_id", "obs_day")}""",
}
