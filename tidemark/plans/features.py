"""Queries of transforms, encodings, cohorts, models, facts and bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import cohorts as C
from tidemark.operators import facts as X
from tidemark.operators import prices as P
from tidemark.operators import ranks as R
from tidemark.operators import reshape as S
from tidemark.operators import ridge as M
from tidemark.plans.common import SCORED, r, rounded, scored_rows, sql_pct
from tidemark.session import table

INF = float("inf")


def _lists(spark, d):
    """One row a cik and list, readings above 0."""
    u = table(spark, d, "universe_lists")
    good = lambda c: F.when((F.col(c) > 0) & (F.col(c) < INF) & ~F.isnan(c), F.col(c))
    return u.groupBy("cik", "list_date").agg(F.min("code").alias("code"), F.min("sector").alias("sector"), *[F.min(good(c)).alias(c) for c in ("close_px", "shares", "mcap", "dollar_vol")])


def melt_long(spark, d):
    u = table(spark, d, "universe_lists").select("list_id", "cik", "close_px", "shares", "mcap")
    return S.melt(u, ["cik"], ["close_px", "shares", "mcap"], "list_id").where("not isnan(value) or value is null")


def widen_first(spark, d):
    o = table(spark, d, "observations").where("entity_id is not null and obs_value is not null and not isnan(obs_value)")
    return rounded(S.widen(o, ["entity_id", "period_end"], "feature", "obs_value", ["size_log", "rev_growth"], "seq"))


def widen_mean(spark, d):
    e = table(spark, d, "events")
    return rounded(S.widen(e, ["user_id"], "event_type", "value", ["click", "view", "purchase"]), 6)


def feature_transforms(spark, d):
    u = _lists(spark, d).where("mcap is not null").withColumn("mcap", F.col("mcap") / 1e9)
    cols = {k: S.transform("mcap", k, "cik", "list_date") for k in ("log", "chg1", "pct1", "pct3")}
    return rounded(u.select("cik", "list_date", *[c.alias(k) for k, c in cols.items()]), 6)


def scoped_candidate(spark, d):
    u = S.with_candidate(_lists(spark, d).where("mcap is not null"), "mcap", "pct1", "cik", "list_date", "cand", "sector", "banks")
    return rounded(u.select("cik", "list_date", "cand", "cand__banks"), 6)


def encode_onehot(spark, d):
    s = scored_rows(spark, d).withColumn("a", F.col("score") + 2)
    return rounded(s.select("panel_id", *[c.alias(k) for k, c in S.one_hot("a").items()]))


def encode_monotone(spark, d):
    s = scored_rows(spark, d).withColumn("a", F.col("score") + 2)
    return rounded(s.select("panel_id", S.level("a").alias("level"), *[c.alias(k) for k, c in S.monotone("a").items()]))


def dummy_columns(spark, d):
    o = table(spark, d, "orders")
    return rounded(o.select("o_orderkey", *[c.alias(k.replace("o_orderstatus", "s")) for k, c in S.dummies("o_orderstatus", ["F", "O", "P"]).items()]))


SECTORS = [(1000, 1499, "mining"), (2000, 2099, "food"), (2830, 2836, "drugs"), (2000, 3999, "manufacturing"), (4000, 4799, "transport"), (4800, 4899, "telecom"), (4900, 4999, "utilities"), (5000, 5199, "wholesale"), (6000, 6799, "finance"), (7370, 7379, "software")]


def sector_ranges(spark, d):
    f = table(spark, d, "filers")
    return f.select("cik", X.plain_name(F.col("company_name")).alias("name"), S.first_range(F.col("sic"), SECTORS, "other").alias("sector"), F.coalesce(F.col("sic").between(1000, 1499) | F.col("sic").between(3200, 3999), F.lit(False)).alias("cyclical"))


def _cohorts(spark, d):
    """Paths of the cohorts formed at every list date that has a 12th later one."""
    u = _lists(spark, d).where("close_px is not null")
    dates = u.select("list_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("list_date")))
    rets = u.select("cik", "list_date", (F.col("close_px") / F.lag("close_px").over(Window.partitionBy("cik").orderBy("list_date")) - 1).alias("r"))
    forms = dates.select(F.col("list_date").alias("entry"), (F.col("k") + 12).alias("k")).join(dates.withColumnRenamed("list_date", "leave"), "k").drop("k")
    last = u.groupBy("cik").agg(F.max("list_date").alias("ended"))
    end = dates.agg(F.max("list_date").alias("e"))
    mem = u.select("cik", F.col("list_date").alias("entry")).join(F.broadcast(forms), "entry").join(last, "cik").join(F.broadcast(end))
    mem = mem.select(F.col("entry").alias("cohort"), "cik", "entry", "leave", F.lit(0.002).alias("cin"), F.lit(0.003).alias("cout"), F.when(F.col("ended") < F.col("e"), F.col("ended")).alias("ended"))
    return C.cohort_paths(mem, rets, "cohort", "cik", "entry", "leave", "list_date", "r", "cin", "cout", "ended")


def cohort_daily(spark, d):
    return rounded(_cohorts(spark, d).select("cohort", "list_date", "r"), 7)


def overlapping_cohorts(spark, d):
    return rounded(C.overlapping(_cohorts(spark, d), "list_date", "r"), 7)


def monthly_compound(spark, d):
    return rounded(C.monthly(C.overlapping(_cohorts(spark, d), "list_date", "r"), "list_date", "r", "cohorts"), 7)


XS = ["score", "rt_cost"]


def _model(spark, d):
    p = table(spark, d, "panel").select("panel_id", "label_end")
    s = R.centred_ranks(scored_rows(spark, d).join(p, "panel_id"), XS, "decision_time")
    return s, M.grams(M.model_rows(s, "fwd_return", "decision_time", "grp"), XS, "target", "decision_time", "label_end")


def ridge_two_feature(spark, d):
    _, g = _model(spark, d)
    w = M.solve(g.mats.sum(0), 10.0)
    return rounded(spark.createDataFrame([tuple(map(float, w))], "c double, b1 double, b2 double"))


WF = M.WalkForward("year", 10.0, 5)


def walkforward_scores(spark, d):
    s, g = _model(spark, d)
    return rounded(M.apply_weights(s, XS, "decision_time", WF.weights(g)).select("panel_id", "score"), 9)


def model_contributions(spark, d):
    s, g = _model(spark, d)
    s = s.withColumns({f"x_{f}": F.col(f) for f in XS})
    return rounded(M.apply_weights(s, [f"x_{f}" for f in XS], "decision_time", WF.weights(g), True).select("panel_id", "c_x_score", "c_x_rt_cost"), 9)


def oof_by_year(spark, d):
    _, g = _model(spark, d)
    rows = [(y, *map(float, w)) for y, w in M.out_of_fold(g, lambda t: t.year).items()]
    return rounded(spark.createDataFrame(rows, "year bigint, c double, b1 double, b2 double"))


def recency_weighted(spark, d):
    s, g = _model(spark, d)
    return rounded(M.apply_weights(s, XS, "decision_time", M.WalkForward("quarter", 10.0, 5, 2, 6.0).weights(g)).select("panel_id", "score"), 9)


def first_reported(spark, d):
    s = table(spark, d, "size_snapshots").where("_available is not null")
    return rounded(X.first_row(s, ["cik", "as_of"], [F.col("_available"), F.col("snap_id")]).select("cik", "as_of", "snap_id", "mcap"))


def _facts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    o = o.withColumn("y", F.year("d")).withColumn("q", F.quarter("d"))
    day = lambda m, dd: F.make_date("y", F.lit(m), F.lit(dd))
    q = o.where("q < 4").groupBy("o_custkey", "y", "q").agg(F.sum("o_totalprice").alias("val"))
    q = q.select("o_custkey", F.add_months(day(1, 1), (F.col("q") - 1) * 3).alias("start"), F.last_day(F.add_months(day(1, 1), F.col("q") * 3 - 1)).alias("end"), "val")
    nine = o.where("q < 4").groupBy("o_custkey", "y").agg(F.sum("o_totalprice").alias("val")).select("o_custkey", day(1, 1).alias("start"), day(9, 30).alias("end"), "val")
    year = o.groupBy("o_custkey", "y").agg(F.sum("o_totalprice").alias("val")).select("o_custkey", day(1, 1).alias("start"), day(12, 31).alias("end"), "val")
    return q.unionByName(nine).unionByName(year).withColumn("filed", F.date_add("end", 40))


def q4_derived(spark, d):
    return rounded(X.with_fourth_quarter(X.durations(_facts(spark, d), "start", "end"), ["o_custkey"], "end", "filed", "val"), 2)


def yoy_growth(spark, d):
    f = _facts(spark, d).where(F.datediff("end", "start") > 350)
    return rounded(f.select("o_custkey", "end", X.growth("val", ["o_custkey"], "end").alias("growth")), 6)


def item_categories(spark, d):
    e = table(spark, d, "eight_k_events").where("category is not null").groupBy("accession").agg(F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("items"))
    names = {"results": "earnings", "debt_added": "debt", "debt_called": "debt", "officer_change": "people", "cyber_incident": "risk"}
    return X.categories(e, "items", names, ["debt_called"]).groupBy("category").agg(F.count("*").alias("n"))


def name_map(spark, d):
    return X.unique_name_map(table(spark, d, "filers"), "company_name", "cik", table(spark, d, "vendor_listings"), "vendor_name", "listing_id")


def spreads_ar_cs(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("value", F.struct("ts", "event_id")).alias("cl"))
    return rounded(P.spreads(e, "user_id", "day", "hi", "lo", "cl", 20, 10).select("user_id", "day", "ar", "cs"), 6)


def clean_bars(spark, d):
    u = table(spark, d, "universe_lists").where("close_px < double('Infinity')").groupBy("cik", "list_date").agg(F.min("close_px").alias("close_px"))
    return rounded(P.drop_bad_prints(u, "cik", "list_date", "close_px"))


def quarter_snapshot(spark, d):
    u = _lists(spark, d).select("cik", "list_date", "close_px", F.avg("dollar_vol").over(Window.partitionBy("cik").orderBy("list_date").rowsBetween(-2, 0)).alias("dv"))
    end = F.last_day(F.add_months(F.trunc("list_date", "quarter"), 2))
    return rounded(P.snapshot(u, "cik", "list_date", end), 4)


def size_bands(spark, d):
    u = _lists(spark, d)
    u = u.withColumn("mcap", P.checked_value(F.col("mcap"), F.col("close_px") * F.col("shares")))
    return rounded(P.size_band(u, "list_date", "cik", "code", "mcap", "dollar_vol", 3e8, 1e10).select("list_date", "cik", "mcap", R.descending_average_rank("mcap", ["list_date"]).alias("rank")), 4)


QUERIES = {
    f.__name__: f
    for f in (
        melt_long, widen_first, widen_mean, feature_transforms, scoped_candidate, encode_onehot, encode_monotone, dummy_columns, sector_ranges, cohort_daily, overlapping_cohorts,
        monthly_compound, ridge_two_feature, walkforward_scores, model_contributions, oof_by_year, recency_weighted, first_reported, q4_derived, yoy_growth, item_categories,
        name_map, spreads_ar_cs, clean_bars, quarter_snapshot, size_bands,
    )
}

_GOOD = lambda c: f"min(CASE WHEN {c} > 0 AND NOT isinf({c}) AND NOT isnan({c}) THEN {c} END) AS {c}"
_U = f"u AS (SELECT cik, list_date, min(code) AS code, min(sector) AS sector, {', '.join(_GOOD(c) for c in ('close_px', 'shares', 'mcap', 'dollar_vol'))} FROM universe_lists GROUP BY 1, 2)"
_LVL = "least(greatest(round_even(score + 2, 0), 0), 4)"
_COH = f"""{_U}, v AS (SELECT * FROM u WHERE close_px IS NOT NULL), dt AS (SELECT list_date, row_number() OVER (ORDER BY list_date) AS k FROM (SELECT DISTINCT list_date FROM v)),
    rt AS (SELECT cik, list_date, close_px / lag(close_px) OVER (PARTITION BY cik ORDER BY list_date) - 1 AS r FROM v),
    fm AS (SELECT a.list_date AS entry, b.list_date AS leave FROM dt a JOIN dt b ON b.k = a.k + 12),
    en AS (SELECT cik, CASE WHEN max(list_date) < (SELECT max(list_date) FROM dt) THEN max(list_date) END AS ended FROM v GROUP BY 1),
    mm AS (SELECT fm.entry, fm.leave, v.cik, en.ended FROM v JOIN fm ON v.list_date = fm.entry JOIN en USING (cik) WHERE ended IS NULL OR ended > entry),
    gd AS (SELECT mm.entry, mm.leave, mm.cik, dt.list_date, 0.998 * product(1 + coalesce(rt.r, 0)) OVER (PARTITION BY mm.entry, mm.cik ORDER BY dt.list_date) AS u1
           FROM mm JOIN dt ON dt.list_date > mm.entry AND dt.list_date <= mm.leave AND (mm.ended IS NULL OR dt.list_date <= mm.ended) LEFT JOIN rt ON rt.cik = mm.cik AND rt.list_date = dt.list_date),
    gl AS (SELECT *, coalesce(lag(u1) OVER (PARTITION BY entry, cik ORDER BY list_date), 1) AS u0 FROM gd),
    pa AS (SELECT entry, list_date, sum(u1 - CASE WHEN list_date = leave THEN u1 * 0.003 ELSE 0 END) / nullif(sum(u0), 0) - 1 AS r FROM gl GROUP BY 1, 2),
    al AS (SELECT DISTINCT mm.entry, dt.list_date FROM mm JOIN dt ON dt.list_date > mm.entry AND dt.list_date <= mm.leave),
    pt AS (SELECT al.entry, al.list_date, coalesce(pa.r, 0) AS r FROM al LEFT JOIN pa USING (entry, list_date)), ov AS (SELECT list_date, avg(r) AS r, count(*) AS cohorts FROM pt GROUP BY 1)"""
_MOD = f"""{SCORED}, x AS (SELECT s.*, p.label_end, coalesce({sql_pct("s.score", "s.decision_time")}, 0.5) - 0.5 AS x1, coalesce({sql_pct("s.rt_cost", "s.decision_time")}, 0.5) - 0.5 AS x2 FROM s JOIN panel p ON p.panel_id = s.panel_id),
    z AS (SELECT *, fwd_return - avg(fwd_return) OVER (PARTITION BY decision_time, grp) AS y, year(timezone('UTC', decision_time)) AS yr FROM x WHERE fwd_return IS NOT NULL)"""
_SUMS = "count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(x1*y) AS s1y, sum(x2*y) AS s2y"
_CENT = "s11 - s1*s1/n + 10 AS a, s12 - s1*s2/n AS b, s22 - s2*s2/n + 10 AS d, s1y - s1*sy/n AS e, s2y - s2*sy/n AS f"
_SOLVE = "(e*d - b*f) / (a*d - b*b) AS b1, (a*f - b*e) / (a*d - b*b) AS b2"
_WFS = f"""{_MOD}, bl AS (SELECT yr, min(decision_time) AS first FROM z WHERE decision_time IN (SELECT decision_time FROM z) GROUP BY 1),
    sm AS (SELECT bl.yr, count(DISTINCT z.decision_time) AS periods, {_SUMS} FROM bl JOIN z ON z.label_end < bl.first GROUP BY 1),
    ct AS (SELECT yr, n, s1, s2, sy, {_CENT} FROM sm WHERE periods >= 5), so AS (SELECT yr, n, s1, s2, sy, {_SOLVE} FROM ct), w AS (SELECT yr, b1, b2, sy/n - b1*s1/n - b2*s2/n AS c FROM so),
    tt AS (SELECT DISTINCT decision_time, yr FROM z)"""
_F = """o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_totalprice AS p FROM orders),
    qq AS (SELECT o_custkey, last_day(make_date(y, q * 3, 1)) AS e, sum(p) AS val FROM o WHERE q < 4 GROUP BY o_custkey, y, q), nn AS (SELECT o_custkey, y, sum(p) AS val FROM o WHERE q < 4 GROUP BY 1, 2), yy AS (SELECT o_custkey, y, sum(p) AS val FROM o GROUP BY 1, 2)"""
_PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(upper({c}), '/[A-Z]{{2}}/?\\s*$', ' '), '&', ' AND '), '[^A-Z0-9 ]', ' ', 'g'), '\\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LP|LLC|TRUST)\\b', ' ', 'g'), ' +', ' ', 'g'))"
_K = "(3 - 2 * sqrt(2.0))"
SQL = {
    "melt_long": f"WITH m AS (SELECT cik, list_id, unnest(['close_px', 'shares', 'mcap']) AS feature, unnest([close_px, shares, mcap]) AS v FROM universe_lists) SELECT cik, list_id, feature, v AS value FROM m WHERE v IS NULL OR NOT isnan(v)",
    "widen_first": "SELECT entity_id, CAST(period_end AS VARCHAR) AS period_end, " + ", ".join(f"{r(f'arg_min(CASE WHEN feature = {chr(39)}{f}{chr(39)} THEN obs_value END, CASE WHEN feature = {chr(39)}{f}{chr(39)} THEN seq END)')} AS {f}" for f in ("size_log", "rev_growth")) + " FROM observations WHERE entity_id IS NOT NULL AND NOT isnan(obs_value) GROUP BY 1, 2",
    "widen_mean": "SELECT user_id, " + ", ".join(f"{r(f'avg(CASE WHEN event_type = {chr(39)}{f}{chr(39)} THEN value END)', 6)} AS {f}" for f in ("click", "view", "purchase")) + " FROM events GROUP BY 1",
    "feature_transforms": f"WITH {_U}, t AS (SELECT cik, list_date, mcap / 1e9 AS mcap FROM u WHERE mcap IS NOT NULL) SELECT cik, CAST(list_date AS VARCHAR) AS list_date, {r('sign(mcap) * ln(1 + abs(mcap))', 6)} AS log, {r('mcap - lag(mcap) OVER w', 6)} AS chg1, {r('(mcap - lag(mcap) OVER w) / nullif(abs(lag(mcap) OVER w), 0)', 6)} AS pct1, {r('(mcap - lag(mcap, 3) OVER w) / nullif(abs(lag(mcap, 3) OVER w), 0)', 6)} AS pct3 FROM t WINDOW w AS (PARTITION BY cik ORDER BY list_date)",
    "scoped_candidate": f"WITH {_U}, t AS (SELECT cik, list_date, sector, (mcap - lag(mcap) OVER w) / nullif(abs(lag(mcap) OVER w), 0) AS c FROM u WHERE mcap IS NOT NULL WINDOW w AS (PARTITION BY cik ORDER BY list_date)) SELECT cik, CAST(list_date AS VARCHAR) AS list_date, {r('c', 6)} AS cand, CASE WHEN sector = 'banks' THEN {r('c', 6)} END AS cand__banks FROM t",
    "encode_onehot": f"WITH {SCORED} SELECT panel_id, " + ", ".join(f"CASE WHEN score IS NOT NULL THEN CASE WHEN {_LVL} = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS a_eq{k}" for k in range(5)) + " FROM s",
    "encode_monotone": f"WITH {SCORED} SELECT panel_id, CASE WHEN score IS NOT NULL THEN {_LVL} + 0.0 END AS level, " + ", ".join(f"CASE WHEN score IS NOT NULL THEN CASE WHEN score + 2 >= {k - 0.5} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS a_ge{k}" for k in range(1, 5)) + " FROM s",
    "dummy_columns": "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_{v}" for v in "FOP") + " FROM orders",
    "sector_ranges": f"SELECT cik, {_PLAIN('company_name')} AS name, CASE " + " ".join(f"WHEN sic BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in SECTORS) + " ELSE 'other' END AS sector, coalesce(sic BETWEEN 1000 AND 1499 OR sic BETWEEN 3200 AND 3999, false) AS cyclical FROM filers",
    "cohort_daily": f"WITH {_COH} SELECT CAST(entry AS VARCHAR) AS cohort, CAST(list_date AS VARCHAR) AS list_date, {r('r', 7)} AS r FROM pt",
    "overlapping_cohorts": f"WITH {_COH} SELECT CAST(list_date AS VARCHAR) AS list_date, {r('r', 7)} AS r, cohorts FROM ov",
    "monthly_compound": f"WITH {_COH} SELECT CAST(CAST(date_trunc('month', list_date) AS DATE) AS VARCHAR) AS month, {r('product(1 + r) - 1', 7)} AS r, min(cohorts) AS cohorts FROM ov GROUP BY 1",
    "ridge_two_feature": f"WITH {_MOD}, sm AS (SELECT {_SUMS} FROM z), ct AS (SELECT n, s1, s2, sy, {_CENT} FROM sm), so AS (SELECT n, s1, s2, sy, {_SOLVE} FROM ct) SELECT {r('sy/n - b1*s1/n - b2*s2/n')} AS c, {r('b1')} AS b1, {r('b2')} AS b2 FROM so",
    "walkforward_scores": f"WITH {_WFS} SELECT x.panel_id, {r('w.c + w.b1 * x.x1 + w.b2 * x.x2', 9)} AS score FROM x JOIN tt USING (decision_time) JOIN w ON w.yr = tt.yr",
    "model_contributions": f"WITH {_WFS} SELECT x.panel_id, {r('w.b1 * x.x1', 9)} AS c_x_score, {r('w.b2 * x.x2', 9)} AS c_x_rt_cost FROM x JOIN tt USING (decision_time) JOIN w ON w.yr = tt.yr",
    "oof_by_year": f"WITH {_MOD}, ys AS (SELECT DISTINCT yr FROM z), sm AS (SELECT ys.yr, {_SUMS} FROM ys JOIN z ON z.yr <> ys.yr GROUP BY 1), ct AS (SELECT yr, n, s1, s2, sy, {_CENT} FROM sm), so AS (SELECT yr, n, s1, s2, sy, {_SOLVE} FROM ct) SELECT yr AS year, {r('sy/n - b1*s1/n - b2*s2/n')} AS c, {r('b1')} AS b1, {r('b2')} AS b2 FROM so",
    "first_reported": f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY cik, as_of ORDER BY _available, snap_id) AS k FROM size_snapshots WHERE _available IS NOT NULL) SELECT cik, CAST(as_of AS VARCHAR) AS as_of, snap_id, {r('mcap')} AS mcap FROM t WHERE k = 1",
    "q4_derived": f"WITH {_F}, al AS (SELECT o_custkey, e, e + 40 AS filed, val FROM qq UNION ALL SELECT yy.o_custkey, make_date(yy.y, 12, 31), make_date(yy.y, 12, 31) + 40, yy.val - nn.val FROM yy JOIN nn ON yy.o_custkey = nn.o_custkey AND yy.y = nn.y) SELECT o_custkey, CAST(e AS VARCHAR) AS \"end\", CAST(CAST(filed AS DATE) AS VARCHAR) AS filed, {r('val', 2)} AS val FROM al",
    "yoy_growth": f"WITH {_F} SELECT o_custkey, CAST(make_date(y, 12, 31) AS VARCHAR) AS \"end\", {r('(val - lag(val) OVER w) / nullif(abs(lag(val) OVER w), 0)', 6)} AS growth FROM yy WINDOW w AS (PARTITION BY o_custkey ORDER BY y)",
    "item_categories": "WITH m AS (SELECT * FROM (VALUES ('results', 'earnings'), ('debt_added', 'debt'), ('officer_change', 'people'), ('cyber_incident', 'risk')) m(c, category)) SELECT m.category, count(DISTINCT e.accession) AS n FROM eight_k_events e JOIN m ON e.category = m.c GROUP BY 1",
    "name_map": f"WITH f AS (SELECT {_PLAIN('company_name')} AS n, cik FROM filers), o AS (SELECT n, min(cik) AS cik FROM f WHERE n <> '' GROUP BY 1 HAVING count(DISTINCT cik) = 1), v AS (SELECT {_PLAIN('vendor_name')} AS n, listing_id FROM vendor_listings) SELECT o.cik, v.listing_id FROM o JOIN v ON o.n = v.n",
    "spreads_ar_cs": f"""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, ln(max(value)) AS h, ln(min(value)) AS l, ln(arg_max(value, struct_pack(a := ts, b := event_id))) AS c FROM events GROUP BY 1, 2),
        m AS (SELECT *, (h + l) / 2 AS m, lead(h) OVER w AS h1, lead(l) OVER w AS l1 FROM b WINDOW w AS (PARTITION BY user_id ORDER BY day)), n AS (SELECT *, lead(m) OVER w AS m1, (h - l) * (h - l) + (h1 - l1) * (h1 - l1) AS be, (greatest(h, h1) - least(l, l1)) * (greatest(h, h1) - least(l, l1)) AS ga FROM m WINDOW w AS (PARTITION BY user_id ORDER BY day)),
        p AS (SELECT *, CASE WHEN h1 IS NOT NULL THEN 4 * (c - m) * (c - m1) END AS ar0, CASE WHEN h1 IS NOT NULL THEN (sqrt(2 * be) - sqrt(be)) / {_K} - sqrt(ga / {_K}) END AS al FROM n), q AS (SELECT *, CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS cs0 FROM p)
        SELECT user_id, CAST(day AS VARCHAR) AS day, {r("CASE WHEN count(ar0) OVER w >= 10 THEN sqrt(greatest(avg(ar0) OVER w, 0)) END", 6)} AS ar, {r("CASE WHEN count(ar0) OVER w >= 10 THEN avg(cs0) OVER w END", 6)} AS cs FROM q WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "quarter_snapshot": f"WITH {_U}, t AS (SELECT cik, list_date, close_px, avg(dollar_vol) OVER (PARTITION BY cik ORDER BY list_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dv, last_day(CAST(date_trunc('quarter', list_date) AS DATE) + INTERVAL 2 MONTH) AS qe FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY cik, qe ORDER BY list_date DESC) AS rn FROM t) SELECT cik, CAST(list_date AS VARCHAR) AS list_date, {r('close_px', 4)} AS close_px, {r('dv', 4)} AS dv, CAST(qe AS VARCHAR) AS quarter_end FROM k WHERE rn = 1 AND qe - list_date <= 7",
    "size_bands": f"WITH {_U}, c AS (SELECT list_date, cik, CASE WHEN close_px * shares IS NULL OR greatest(mcap / (close_px * shares), close_px * shares / mcap) <= 3 THEN mcap END AS mcap FROM u), b AS (SELECT * FROM c WHERE mcap >= 3e8 AND mcap < 1e10) SELECT CAST(list_date AS VARCHAR) AS list_date, cik, {r('mcap', 4)} AS mcap, rank() OVER (PARTITION BY list_date ORDER BY mcap DESC) + (count(*) OVER (PARTITION BY list_date, mcap) - 1) / 2.0 AS rank FROM b",
}
