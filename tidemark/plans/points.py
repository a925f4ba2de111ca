"""Queries of as-of joins, trailing windows, labels and checks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import labels as L
from tidemark.operators import windows as V
from tidemark.plans.common import r, rounded
from tidemark.session import number, table

DAY = 86_400_000_000
FEATURES = ["size_log", "rev_growth", "guidance_tone"]


def day_start(c):
    return F.timestamp_micros(F.unix_date(c).cast("long") * F.lit(DAY))


def _obs(spark, d):
    o = table(spark, d, "observations").where(F.col("entity_id").isNotNull())
    return o.select("seq", "entity_id", "available_at", "feature", number(F.col("obs_value")).alias("x"))


def _panel(spark, d):
    return table(spark, d, "panel").select("panel_id", "entity_id", "decision_time", "entry_time", "label_end")


def _attached(spark, d, age=None):
    return A.attach(_panel(spark, d), "entity_id", "decision_time", _obs(spark, d), "feature", "x", "available_at", "seq", FEATURES, age)


def asof_latest_value(spark, d):
    return rounded(_attached(spark, d).select("panel_id", *[f"{p}_{f}" for f in FEATURES for p in ("x", "at")]))


def asof_staleness(spark, d):
    return rounded(_attached(spark, d, 90).select("panel_id", *[f"{p}_{f}" for f in FEATURES for p in ("x", "at")]))


def asof_single(spark, d):
    o = _obs(spark, d).where("feature = 'size_log'")
    got = A.asof(_panel(spark, d).select("panel_id", "entity_id", "decision_time"), "decision_time", o, "available_at", ["entity_id"], "seq", ["x"])
    return rounded(got.select("panel_id", "x", "known_at"))


def asof_inclusive(spark, d):
    s = table(spark, d, "size_snapshots").select("cik", "snap_id", "_available", "mcap")
    q = table(spark, d, "universe_lists").select("list_id", "cik", day_start(F.col("list_date")).alias("t"))
    got = A.asof(q, "t", s, "_available", ["cik"], "snap_id", ["mcap"], inclusive=True, max_age_days=400)
    return rounded(got.select("list_id", "mcap", "known_at"))


def asof_document(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "entity_id", "available_at", F.length("text").cast("long").alias("chars"), F.col("doc_id").alias("doc"))
    got = A.asof(_panel(spark, d).select("panel_id", "entity_id", "decision_time"), "decision_time", docs, "available_at", ["entity_id"], "doc_id", ["doc", "chars"])
    return rounded(got.select("panel_id", "doc", "chars"))


def asof_forward(spark, d):
    o = _obs(spark, d).where("feature = 'size_log'")
    got = A.asof(_panel(spark, d).select("panel_id", "entity_id", "decision_time"), "decision_time", o, "available_at", ["entity_id"], "seq", ["x"], forward=True, provenance="next_at")
    return rounded(got.select("panel_id", "x", "next_at"))


def _bars(spark, d):
    u = table(spark, d, "universe_lists").where("code is not null and close_px > 0 and close_px < double('Infinity') and not isnan(close_px)")
    return u.groupBy("code", "list_date").agg(F.min("close_px").alias("px"), F.min("dollar_vol").alias("dv")).select(F.col("code").alias("entity_id"), "list_date", day_start(F.col("list_date")).alias("close_at"), "px", "dv")


def next_bar_entry(spark, d):
    got = A.asof(_panel(spark, d).select("panel_id", "entity_id", "decision_time"), "decision_time", _bars(spark, d).withColumn("n", F.lit(0)), "close_at", ["entity_id"], "n", ["px"], forward=True, provenance="entry")
    return rounded(got.select("panel_id", "px", "entry"))


def forward_return(spark, d):
    b = L.with_ended(_bars(spark, d), "entity_id", "close_at", 62)
    got = L.forward_returns(_panel(spark, d).select("panel_id", "entity_id", "decision_time"), "decision_time", b, "entity_id", "close_at", "px", 3, ended="ended", min_history=2)
    return rounded(got.select("panel_id", "entry_time", "label_end", "fwd_return", "delisted"))


def daily_return_last_bar(spark, d):
    b = L.with_ended(_bars(spark, d), "entity_id", "close_at", 62)
    return rounded(L.daily_returns(b, "entity_id", "close_at", "px", "ended"))


def universe_active(spark, d):
    """Monthly decisions from the first bar to the last. (L4)"""
    b = _bars(spark, d)
    first, last = b.agg(F.min("list_date"), F.max("list_date")).first()
    times = L.schedule(first, last + timedelta(1), "trading", "monthly", "America/New_York", "16:00", 30) if first else []
    return rounded(L.universe(L.schedule_table(spark, times), b, "entity_id", "close_at", 40))


def leak_check_counts(spark, d):
    p = _attached(spark, d)
    cells = [f"at_{f}" for f in FEATURES]
    filled = sum((F.sum(F.col(c).isNotNull().cast("long")) for c in cells[1:]), F.sum(F.col(cells[0]).isNotNull().cast("long")))
    early = F.sum(L.leaks(p, "decision_time", cells).cast("long"))
    return p.agg(F.count("*").alias("rows"), filled.alias("filled"), early.alias("leaks"), F.sum(F.coalesce(F.col("entry_time") <= F.col("decision_time"), F.lit(False)).cast("long")).alias("early_entries"))


def nearest_earlier(spark, d):
    s = table(spark, d, "size_snapshots").where("mcap is not null")
    f = s.groupBy("cik", "as_of").agg(F.max("mcap").alias("mcap"))
    got = A.nearest(f, f, ["cik"], "as_of", "as_of", 364, 20, "mcap", "mcap_before")
    return rounded(got.select("cik", "as_of", "mcap_before", (F.col("mcap") / F.nullif("mcap_before", F.lit(0.0)) - 1).alias("growth")))


def _ev(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def rolling_event_window(spark, d):
    """Events of the week before each day from a user's first event to a week after the last."""
    days = _ev(spark, d).groupBy("user_id").agg(F.floor(F.min(F.unix_micros("ts")) / DAY).alias("a"), F.floor(F.max(F.unix_micros("ts")) / DAY).alias("b"))
    pts = days.select("user_id", F.explode(F.sequence(F.col("a"), F.col("b") + 8)).alias("day")).select((F.col("user_id") * 100_000 + F.col("day")).alias("point"), "user_id", F.timestamp_micros(F.col("day") * DAY).alias("t"))
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total"), F.countDistinct("event_type").alias("kinds")]
    got = A.in_window(pts, "t", _ev(spark, d), "ts", ["user_id"], 7, aggs, "point")
    return rounded(got.select("point", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("kinds", F.lit(0)).alias("kinds")), 4)


def event_change_points(spark, d):
    return rounded(V.change_points(_ev(spark, d), ["user_id", "event_type"], "ts", F.col("value"), 7), 4)


def change_vs_prior_k(spark, d):
    e = _ev(spark, d)
    return rounded(e.select("event_id", (F.col("value") - V.prior_mean("value", ["user_id", "event_type"], ["ts", "event_id"], 4, 2)).alias("change")), 6)


def rolling_median_5(spark, d):
    return rounded(_ev(spark, d).select("event_id", V.rolling_median("value", ["user_id"], ["ts", "event_id"], 5).alias("median")), 6)


def price_features(spark, d):
    b = _bars(spark, d).where(F.col("dv").isNotNull() & ~F.isnan("dv"))
    return rounded(V.price_features(b.select("entity_id", "close_at", "px", "dv"), "entity_id", "close_at", "px", "dv").drop("px", "dv"), 6)


LEVELS = [[], ["event_type"], ["event_type", "user_id"]]


def shrunk_mean(spark, d):
    return rounded(V.shrunk_means(_ev(spark, d), "value", "ts", LEVELS, 20.0).select("event_id", "mean"), 6)


def surprise_shrunk_mean(spark, d):
    return rounded(V.surprise(_ev(spark, d), "value", "ts", LEVELS, 20.0).select("event_id", "surprise"), 6)


def base_rates_lagged(spark, d):
    e = _ev(spark, d)
    got = V.shrunk_means(e, "value", "ts", LEVELS[1:], 10.0, lag_days=2, out="rate", prior=0.5, truth=(F.col("value") > 50).cast("double"))
    return rounded(got.select("event_id", "rate"), 6)


def observation_features(spark, d):
    """Entity days with the trailing count of 8-K categories, as wide features."""
    e = table(spark, d, "eight_k_events").where("category is not null and published_at is not null")
    day = F.date_from_unix_date(F.floor(F.unix_micros("published_at") / DAY).cast("int"))
    e = e.groupBy("entity", day.alias("day")).pivot("category", ["results", "officer_change", "debt_added"]).agg(F.countDistinct("accession"))
    w = Window.partitionBy("entity").orderBy(F.unix_date("day")).rangeBetween(-29, 0)
    cols = ["results", "officer_change", "debt_added"]
    return rounded(e.select("entity", "day", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in cols]))


QUERIES = {
    f.__name__: f
    for f in (
        asof_latest_value, asof_staleness, asof_single, asof_inclusive, asof_document, asof_forward, next_bar_entry, forward_return, daily_return_last_bar, universe_active,
        leak_check_counts, nearest_earlier, rolling_event_window, event_change_points, change_vs_prior_k, rolling_median_5, price_features, shrunk_mean, surprise_shrunk_mean,
        base_rates_lagged, observation_features,
    )
}

_O = "o AS (SELECT entity_id, feature, epoch_us(available_at) AS t, CASE WHEN NOT isnan(obs_value) THEN obs_value END AS x FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature, available_at ORDER BY seq DESC) AS z FROM observations WHERE entity_id IS NOT NULL AND available_at IS NOT NULL) WHERE z = 1)"
_P = "p AS (SELECT panel_id, entity_id, epoch_us(decision_time) AS t, epoch_us(entry_time) AS e FROM panel)"


def _attach_sql(age: int | None) -> str:
    parts = [f"{f} AS (SELECT p.panel_id, o.x, o.t FROM p ASOF JOIN (SELECT * FROM o WHERE feature = '{f}') o ON p.entity_id = o.entity_id AND p.t > o.t{f' WHERE p.t - o.t <= {age * DAY}' if age else ''})" for f in FEATURES]
    cols = ", ".join(f"{r(f + '.x')} AS x_{f}, {f}.t AS at_{f}" for f in FEATURES)
    return f"WITH {_O}, {_P}, {', '.join(parts)} SELECT p.panel_id, {cols} FROM p " + " ".join(f"LEFT JOIN {f} ON {f}.panel_id = p.panel_id" for f in FEATURES)


_B = "b AS (SELECT code AS entity_id, list_date, epoch_us(CAST(list_date AS TIMESTAMP)) AS t, min(close_px) AS px, min(dollar_vol) AS dv FROM universe_lists WHERE code IS NOT NULL AND close_px > 0 AND NOT isinf(close_px) AND NOT isnan(close_px) GROUP BY ALL)"
_BE = f"{_B}, be AS (SELECT *, datediff('day', max(list_date) OVER (PARTITION BY entity_id), (SELECT max(list_date) FROM b)) > 62 AS ended FROM b)"


def _shrunk(out: str, x: str, k: float, lag: int, levels: list, prior: float) -> str:
    ctes, mean, seen = [], str(prior), []
    cols = []
    for i, keys in enumerate(levels):
        w = f"(PARTITION BY {', '.join(keys) or '1'} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {lag + 1} PRECEDING)"
        cols += [f"count({x}) OVER {w} AS n{i}", f"coalesce(sum({x}) OVER {w}, 0) AS s{i}"]
        seen.append(f"n{i}")
    ctes.append(f"SELECT event_id, value, {', '.join(cols)} FROM e")
    for i in range(len(levels)):
        mean = f"(CASE WHEN n{i} > 0 THEN (s{i} + {k} * {mean}) / (n{i} + {k}) ELSE {mean} END)"
    m = f"CASE WHEN {' + '.join(seen)} > 0 THEN {mean} END"
    return f"WITH e AS (SELECT *, epoch_us(ts) AS t FROM events), z AS ({ctes[0]}) SELECT event_id, {r(out.replace('$', m), 6)} AS "


SQL = {
    "asof_latest_value": _attach_sql(None),
    "asof_staleness": _attach_sql(90),
    "asof_single": f"WITH {_O}, {_P} SELECT p.panel_id, {r('o.x')} AS x, o.t AS known_at FROM p ASOF LEFT JOIN (SELECT * FROM o WHERE feature = 'size_log') o ON p.entity_id = o.entity_id AND p.t > o.t",
    "asof_inclusive": f"WITH s AS (SELECT cik, epoch_us(_available) AS t, arg_max(snap_id, snap_id) AS id FROM size_snapshots WHERE _available IS NOT NULL GROUP BY ALL), m AS (SELECT s.cik, s.t, z.mcap FROM s JOIN size_snapshots z ON z.snap_id = s.id), u AS (SELECT list_id, cik, epoch_us(CAST(list_date AS TIMESTAMP)) AS t FROM universe_lists), j AS (SELECT u.list_id, m.mcap, m.t, u.t AS ut FROM u ASOF LEFT JOIN m ON u.cik = m.cik AND u.t >= m.t) SELECT list_id, CASE WHEN ut - t <= {400 * DAY} THEN {r('mcap')} END AS mcap, CASE WHEN ut - t <= {400 * DAY} THEN t END AS known_at FROM j",
    "asof_document": f"WITH {_P}, d AS (SELECT entity_id, epoch_us(available_at) AS t, max(doc_id) AS doc FROM documents WHERE text IS NOT NULL AND available_at IS NOT NULL GROUP BY ALL) SELECT p.panel_id, d.doc, length(x.text) AS chars FROM p ASOF LEFT JOIN d ON p.entity_id = d.entity_id AND p.t > d.t LEFT JOIN documents x ON x.doc_id = d.doc",
    "asof_forward": f"WITH {_P}, o AS (SELECT entity_id, epoch_us(available_at) AS t, CASE WHEN NOT isnan(obs_value) THEN obs_value END AS x FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, available_at ORDER BY seq) AS z FROM observations WHERE entity_id IS NOT NULL AND available_at IS NOT NULL AND feature = 'size_log') WHERE z = 1) SELECT p.panel_id, {r('o.x')} AS x, o.t AS next_at FROM p ASOF LEFT JOIN o ON p.entity_id = o.entity_id AND p.t < o.t",
    "next_bar_entry": f"WITH {_P}, {_B} SELECT p.panel_id, {r('b.px')} AS px, b.t AS entry FROM p ASOF LEFT JOIN b ON p.entity_id = b.entity_id AND p.t < b.t",
    "forward_return": f"""WITH {_P}, {_BE}, w AS (SELECT *, lead(px, 3) OVER z AS p1, lead(t, 3) OVER z AS t1, last_value(px) OVER y AS pl, last_value(t) OVER y AS tl, row_number() OVER z AS i FROM be WINDOW z AS (PARTITION BY entity_id ORDER BY t), y AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        j AS (SELECT p.panel_id, w.* FROM p ASOF LEFT JOIN w ON p.entity_id = w.entity_id AND p.t < w.t) SELECT panel_id, t AS entry_time, CASE WHEN p1 IS NOT NULL THEN t1 WHEN ended THEN tl END AS label_end, {r("CASE WHEN p1 IS NOT NULL THEN p1 / px - 1 WHEN ended THEN pl / px * (1 - 0.3) - 1 END")} AS fwd_return, coalesce(p1 IS NULL AND ended, false) AS delisted FROM j WHERE i IS NULL OR i - 1 >= 2""",
    "daily_return_last_bar": f"WITH {_BE}, w AS (SELECT *, px / lag(px) OVER z - 1 AS q, lead(t) OVER z IS NULL AND ended AS l FROM be WINDOW z AS (PARTITION BY entity_id ORDER BY t)) SELECT entity_id, t AS close_at, {r('CASE WHEN l THEN (1 + q) * (1 - 0.3) - 1 ELSE q END')} AS r FROM w",
    "universe_active": f"""WITH {_B}, lo AS (SELECT min(list_date) AS a, max(list_date) AS z FROM b), mo AS (SELECT last_day(unnest(generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH))) AS m FROM lo),
        wd AS (SELECT CAST(m - CAST(greatest(isodow(m) - 5, 0) AS INTEGER) AS DATE) AS w FROM mo), c AS (SELECT epoch_us(timezone('America/New_York', CAST(w AS TIMESTAMP) + INTERVAL '16 hours 30 minutes')) AS t FROM wd, lo WHERE w BETWEEN a AND z),
        e AS (SELECT DISTINCT entity_id FROM b), d AS (SELECT c.t, e.entity_id FROM c, e) SELECT d.t AS decision_time, d.entity_id, 'all' AS grp FROM d ASOF JOIN b ON d.entity_id = b.entity_id AND d.t > b.t WHERE d.t - b.t <= {40 * DAY}""",
    "leak_check_counts": _attach_sql(None).replace("WITH ", "WITH y AS (WITH ", 1) + "), x AS (SELECT * FROM y JOIN panel USING (panel_id)) SELECT count(*) AS rows, CAST(sum((at_size_log IS NOT NULL)::INT + (at_rev_growth IS NOT NULL)::INT + (at_guidance_tone IS NOT NULL)::INT) AS BIGINT) AS filled, CAST(sum(CASE WHEN greatest(coalesce(at_size_log, 0), coalesce(at_rev_growth, 0), coalesce(at_guidance_tone, 0)) >= epoch_us(decision_time) THEN 1 ELSE 0 END) AS BIGINT) AS leaks, CAST(sum(CASE WHEN entry_time <= decision_time THEN 1 ELSE 0 END) AS BIGINT) AS early_entries FROM x",
    "nearest_earlier": f"WITH f AS (SELECT cik, as_of, max(mcap) AS mcap FROM size_snapshots WHERE mcap IS NOT NULL GROUP BY ALL), b AS (SELECT a.cik, a.as_of, arg_min(z.mcap, abs(datediff('day', z.as_of, a.as_of) - 364) * 100000 + (z.as_of - DATE '1990-01-01')) AS mb FROM f a JOIN f z ON a.cik = z.cik AND abs(datediff('day', z.as_of, a.as_of) - 364) <= 20 GROUP BY ALL) SELECT f.cik, CAST(f.as_of AS VARCHAR) AS as_of, {r('mb')} AS mcap_before, {r('mcap / nullif(mb, 0) - 1')} AS growth FROM f LEFT JOIN b USING (cik, as_of)",
    "rolling_event_window": f"WITH p AS (SELECT user_id, unnest(range(min(epoch_us(ts)) // {DAY}, max(epoch_us(ts)) // {DAY} + 9)) * {DAY} AS t FROM events GROUP BY 1) SELECT CAST(p.user_id * 100000 + t // {DAY} AS BIGINT) AS point, count(e.event_id) AS n, {r('coalesce(sum(e.value), 0)', 4)} AS total, count(DISTINCT e.event_type) AS kinds FROM p LEFT JOIN events e ON e.user_id = p.user_id AND epoch_us(e.ts) < t AND epoch_us(e.ts) > t - {7 * DAY} GROUP BY p.user_id, p.t",
    "event_change_points": f"WITH s AS (SELECT user_id, event_type, epoch_us(ts) AS t, 1 AS n, value AS w FROM events UNION ALL SELECT user_id, event_type, epoch_us(ts) + {7 * DAY}, -1, -value FROM events), a AS (SELECT user_id, event_type, t, sum(n) AS n, sum(w) AS w FROM s GROUP BY ALL) SELECT user_id, event_type, t AS \"at\", CAST(sum(n) OVER z AS BIGINT) AS n, {r('sum(w) OVER z', 4)} AS total FROM a WINDOW z AS (PARTITION BY user_id, event_type ORDER BY t)",
    "change_vs_prior_k": f"SELECT event_id, {r('value - CASE WHEN count(value) OVER z >= 2 THEN avg(value) OVER z END', 6)} AS change FROM events WINDOW z AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "rolling_median_5": f"SELECT event_id, {r('median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 6)} AS median FROM events",
    "price_features": f"""WITH {_B}, c AS (SELECT *, px * dv AS pv, px / lag(px) OVER w - 1 AS q, row_number() OVER w > 12 AS f FROM b WHERE dv IS NOT NULL AND NOT isnan(dv) WINDOW w AS (PARTITION BY entity_id ORDER BY t))
        SELECT entity_id, t AS close_at, {r("CASE WHEN f THEN px / lag(px, 1) OVER w - 1 END", 6)} AS mom_1, {r("CASE WHEN f THEN lag(px, 1) OVER w / lag(px, 12) OVER w - 1 END", 6)} AS mom_12_1, {r("CASE WHEN f THEN stddev_samp(q) OVER v6 END", 6)} AS vol,
        {r("CASE WHEN f THEN px / max(px) OVER v12 - 1 END", 6)} AS from_high, {r("CASE WHEN f THEN avg(pv) OVER v3 / nullif(avg(pv) OVER v6, 0) END", 6)} AS volume_ratio FROM c
        WINDOW w AS (PARTITION BY entity_id ORDER BY t), v3 AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), v6 AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), v12 AS (PARTITION BY entity_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    "shrunk_mean": _shrunk("$", "value", 20.0, 0, LEVELS, 0.0) + "mean FROM z",
    "surprise_shrunk_mean": _shrunk("value - $", "value", 20.0, 0, LEVELS, 0.0) + "surprise FROM z",
    "base_rates_lagged": _shrunk("$", "(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END)", 10.0, 2 * DAY, LEVELS[1:], 0.5) + "rate FROM z",
    "observation_features": f"WITH e AS (SELECT entity, DATE '1970-01-01' + CAST(epoch_us(published_at) // {DAY} AS INTEGER) AS day, " + ", ".join(f"count(DISTINCT CASE WHEN category = '{c}' THEN accession END) AS {c}" for c in ("results", "officer_change", "debt_added")) + " FROM eight_k_events WHERE category IS NOT NULL AND published_at IS NOT NULL GROUP BY 1, 2) SELECT entity, CAST(day AS VARCHAR) AS day, " + ", ".join(f"CAST(sum({c}) OVER z AS BIGINT) AS {c}" for c in ("results", "officer_change", "debt_added")) + " FROM e WINDOW z AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)",
}
