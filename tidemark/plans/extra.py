"""Queries of list universes, interval joins, directional events and book-keeping tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import grading as G
from tidemark.operators import rolling as T
from tidemark.operators import windows as H
from tidemark.plans import governance as V
from tidemark.plans.common import r, rounded
from tidemark.plans.points import DAY, day_start
from tidemark.session import table
from tidemark.sources.files import size_source


def universe_from_lists(spark, d):
    """Names of the latest list strictly before each decision, without excluded kinds of names."""
    u = table(spark, d, "universe_lists")
    days = u.select(day_start(F.col("list_date")).alias("at"), "list_date").distinct().withColumns({"one": F.lit(1), "seq": F.lit(0)})
    p = table(spark, d, "panel").select("decision_time").distinct().withColumn("one", F.lit(1))
    got = A.asof(p, "decision_time", days, "at", ["one"], "seq", ["list_date"])
    names = u.where(~F.col("company_name").rlike("(?i)trust|partners")).groupBy("list_date").agg(F.countDistinct("cik").alias("names"))
    return rounded(got.join(names, "list_date").select("decision_time", "list_date", "names"))


def interval_events(spark, d):
    """Deals closed around the end of a company's lists: from 90 days before to 30 after."""
    last = table(spark, d, "universe_lists").groupBy("cik").agg(F.max("list_date").alias("last"))
    e = table(spark, d, "eight_k_events").where("category = 'deal_closed' and published_at is not null").select(T.cik_of("trim(entity)").alias("cik"), F.date_from_unix_date(F.floor(F.unix_micros("published_at") / DAY).cast("int")).alias("day"), "accession")
    hit = last.join(e, "cik").where((F.col("day") >= F.date_sub("last", 90)) & (F.col("day") <= F.date_add("last", 30)))
    return rounded(last.join(hit.groupBy("cik").agg(F.countDistinct("accession").alias("deals")), "cik", "left").select("cik", "last", F.coalesce("deals", F.lit(0)).alias("deals")))


def event_direction_share(spark, d):
    """Net direction of an entity's events over the 90 days before each of its own, 0 where there were none."""
    e = table(spark, d, "eight_k_events").where("published_at is not null").select("event_id", T.cik_of("trim(entity)").alias("cik"), F.unix_micros("published_at").alias("t"), F.when(~F.isnan("direction"), F.col("direction")).alias("x"), "category")
    got = H.trailing(e, "cik", "t", 90 * DAY, "x", "category")
    return rounded(got.select("event_id", "n", F.when(F.col("gross") > 1e-9, F.col("total") / F.nullif(F.col("gross"), F.lit(0.0))).otherwise(0.0).alias("share"), "kinds"), 6)


_CAP = [("1-URGENT", 5e4), ("unused", 1.0)]


def registry_bar_counts(spark, d):
    """The scored deliveries as a registry: a line each, with a text where a t should be for missing scores."""
    s = table(spark, d, "scored").select(
        F.concat(F.lit("m"), F.col("block").cast("string")).alias("market"), F.when(F.col("panel_id") % 2 == 0, "test").otherwise("loop_internal").alias("kind"), F.when(F.col("score").isNull() | F.isnan("score"), "open").otherwise(F.col("score").cast("string")).alias("t"),
        F.lit(1).cast("long").alias("count"), F.when(F.col("fwd_return").isNull(), "check").otherwise("tuning").alias("stage"), F.when(F.col("score") > 1, "kept").otherwise("dropped").alias("verdict"),
    )
    return V.bar_counts(s)


def ledger_caps(spark, d):
    """The orders as a ledger of spending by priority, against caps of two steps."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("step"), F.col("o_totalprice").cast("double").alias("usd"))
    return rounded(V.spend_by(o, spark.createDataFrame(_CAP, "step string, cap double")), 2)


def size_observations(spark, d):
    """Log market value of each list row, as observations."""
    got = size_source(table(spark, d, "universe_lists"), "code", "_available", "mcap", "list_id")
    return rounded(got.where("value is not null"), 6)


def document_changes(spark, d):
    """Whether a document's quality fields moved against the entity's one before."""
    t = table(spark, d, "documents").where("text is not null and available_at is not null").select("doc_id", "entity_id", "available_at", F.length("text").cast("double").alias("n"))
    w = Window.partitionBy("entity_id").orderBy("available_at", "doc_id")
    return t.select("doc_id", F.coalesce(G.stable(F.log10(F.col("n") + 1), F.log10(F.lag("n").over(w) + 1), "scale"), F.lit(False)).alias("same_size"))


QUERIES = {f.__name__: f for f in (universe_from_lists, interval_events, event_direction_share, registry_bar_counts, ledger_caps, document_changes, size_observations)}
_CIK = "TRY_CAST(nullif(regexp_extract(trim(entity), '(?i)^(?:CIK)?[ :#-]*([0-9]{1,18})$', 1), '') AS BIGINT)"
_VAL = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
SQL = {
    "universe_from_lists": "WITH l AS (SELECT DISTINCT list_date, epoch_us(CAST(list_date AS TIMESTAMP)) AS t FROM universe_lists), p AS (SELECT DISTINCT epoch_us(decision_time) AS t FROM panel), j AS (SELECT p.t, l.list_date FROM p ASOF JOIN l ON p.t > l.t), n AS (SELECT list_date, count(DISTINCT cik) AS names FROM universe_lists WHERE NOT regexp_matches(company_name, '(?i)trust|partners') GROUP BY 1) SELECT j.t AS decision_time, CAST(j.list_date AS VARCHAR) AS list_date, n.names FROM j JOIN n USING (list_date)",
    "interval_events": f"WITH l AS (SELECT cik, max(list_date) AS last FROM universe_lists GROUP BY 1), e AS (SELECT {_CIK} AS cik, DATE '1970-01-01' + CAST(epoch_us(published_at) // {DAY} AS INTEGER) AS day, accession FROM eight_k_events WHERE category = 'deal_closed' AND published_at IS NOT NULL) SELECT l.cik, CAST(l.last AS VARCHAR) AS last, count(DISTINCT e.accession) AS deals FROM l LEFT JOIN e ON e.cik = l.cik AND e.day >= l.last - 90 AND e.day <= l.last + 30 GROUP BY 1, 2",
    "event_direction_share": f"WITH e AS (SELECT event_id, {_CIK} AS cik, epoch_us(published_at) AS t, CASE WHEN NOT isnan(direction) THEN direction END AS x, category FROM eight_k_events WHERE published_at IS NOT NULL), w AS (SELECT event_id, count(*) OVER z AS n, coalesce(sum(x) OVER z, 0) AS a, coalesce(sum(abs(x)) OVER z, 0) AS g, count(DISTINCT category) OVER z AS kinds FROM e WINDOW z AS (PARTITION BY cik ORDER BY t RANGE BETWEEN {90 * DAY} PRECEDING AND 1 PRECEDING)) SELECT event_id, n, {r('CASE WHEN g > 1e-9 THEN a / g ELSE 0 END', 6)} AS share, kinds FROM w",
    "registry_bar_counts": "SELECT 'm' || block AS market, CAST(sum(CASE WHEN panel_id % 2 = 0 AND (score IS NULL OR isnan(score)) THEN 0 ELSE 1 END) AS BIGINT) AS judged, count(CASE WHEN fwd_return IS NULL THEN 1 END) AS checks, count(CASE WHEN score > 1 THEN 1 END) AS kept FROM scored GROUP BY 1",
    "ledger_caps": f"WITH l AS (SELECT o_orderpriority AS step, sum(CAST(o_totalprice AS DOUBLE)) AS spent FROM orders GROUP BY 1), c AS (SELECT * FROM (VALUES {_VAL(_CAP)}) c(step, cap)) SELECT coalesce(l.step, c.step) AS step, {r('c.cap::DOUBLE', 2)} AS cap, {r('coalesce(l.spent, 0)::DOUBLE', 2)} AS spent FROM l FULL JOIN c ON l.step = c.step",
    "size_observations": f"SELECT code AS entity_id, epoch_us(_available) AS available_at, 'universe' AS source, 'size_log' AS feature, {r('ln(mcap)', 6)} AS value, list_id AS seq FROM universe_lists WHERE code IS NOT NULL AND _available IS NOT NULL AND mcap > 0 AND mcap < 'Infinity'::DOUBLE AND NOT isnan(mcap)",
    "document_changes": "WITH t AS (SELECT doc_id, abs(log10(length(text) + 1) - log10(lag(length(text)) OVER (PARTITION BY entity_id ORDER BY available_at, doc_id) + 1)) < 0.5 AS s FROM documents WHERE text IS NOT NULL AND available_at IS NOT NULL) SELECT doc_id, coalesce(s, false) AS same_size FROM t",
}
