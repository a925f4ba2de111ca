"""Queries that cover the whole of their tables."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark import registry


def test_universe_covers_every_month_of_the_bars(spark, tmp_path):
    first = date(2008, 1, 31)
    days = [first + timedelta(30 * k) for k in range(12 * 16)]
    spark.createDataFrame([("a", t, 5.0, 1.0) for t in days], "code string, list_date date, close_px double, dollar_vol double").write.parquet(f"{tmp_path}/universe_lists.parquet")
    got = registry.CORE["universe_active"](spark, str(tmp_path)).select(F.timestamp_micros("decision_time").alias("t"))
    years = {r.y for r in got.select(F.year("t").alias("y")).distinct().collect()}
    assert years == {t.year for t in days}
    last = days[-1]
    months = (last.year - first.year) * 12 + last.month - first.month
    assert got.count() in (months, months + 1)


def test_cohorts_form_at_every_date_with_a_12th_later(spark, tmp_path):
    days = [date(2020, 1, 1) + timedelta(k) for k in range(30)]
    rows = [(1, t, "a", "s", 5.0 + k, 1.0, 1.0, 1.0) for k, t in enumerate(days)]
    spark.createDataFrame(rows, "cik long, list_date date, code string, sector string, close_px double, shares double, mcap double, dollar_vol double").write.parquet(f"{tmp_path}/universe_lists.parquet")
    got = {r.cohort for r in registry.CORE["cohort_daily"](spark, str(tmp_path)).select("cohort").distinct().collect()}
    assert got == {str(t) for t in days[:-12]}
    most = registry.CORE["overlapping_cohorts"](spark, str(tmp_path)).agg(F.max("cohorts")).first()[0]
    assert most == 12


def test_observation_totals_on_every_calendar_day(spark, tmp_path):
    stamps = ["2024-01-01 15:00:00", "2024-01-01 16:00:00", "2024-01-05 15:00:00", "2024-03-01 02:00:00"]
    rows = [("a", t) for t in stamps] + [("a", None), (None, stamps[0])]
    spark.createDataFrame(rows, "entity_id string, at string").select("entity_id", F.col("at").cast("timestamp").alias("available_at")).write.parquet(f"{tmp_path}/observations.parquet")
    got = {r.obs_day: (r.n7, r.n30) for r in registry.CORE["p4_observations"](spark, str(tmp_path)).collect()}
    first, at = date(2024, 1, 1), [0, 0, 4, 59]  # the last stamp is the evening before in New York
    assert got == {str(first + timedelta(k)): (sum(k - 7 < x <= k for x in at), sum(k - 30 < x <= k for x in at)) for k in range(59 + 30)}
