"""Queries of fundamentals, spreads, costs, universes and insiders' trades.

The list readings stand in for reported facts and bars: dollar volume as revenue, market value as assets, closes and
shares as other facts; a list is a bar whose range is spanned by its close and the one before."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as X
from tidemark.operators import prices as P
from tidemark.plans.common import r, rounded
from tidemark.session import local_date, table

INF = float("inf")
NY = "America/New_York"
ANNUAL = {"dollar_vol": "revenue", "mcap": "total_assets", "close_px": "net_income", "shares": "shares"}
QUARTER = {"dollar_vol": "revenue", "mcap": "cost_of_revenue", "close_px": "inventory", "shares": "rnd"}


def _facts(spark, d, concepts, months):
    u = table(spark, d, "universe_lists").where(F.month("list_date").isin(*months) & F.col("_available").isNotNull())
    u = u.select(F.col("cik").alias("entity"), F.col("list_date").alias("end"), local_date(F.col("_available"), NY).alias("filed"), *[F.when((F.col(c) > 0) & (F.col(c) < INF), F.col(c)).alias(n) for c, n in concepts.items()])
    return u.unpivot(["entity", "end", "filed"], list(concepts.values()), "concept", "val").where("val is not null")


def annual_ratios(spark, d):
    got = X.annual_ratios(_facts(spark, d, ANNUAL, [12]))
    return rounded(got.select("entity", "end", "filed", "revenue_growth", "net_margin", "roa", "gross_margin", "share_dilution"), 6)


def quarterly_features(spark, d):
    got = X.quarterly_features(_facts(spark, d, QUARTER, [3, 6, 9, 12]), extended=True)
    return rounded(got, 6)


def fundamental_observations(spark, d):
    got = X.annual_ratios(_facts(spark, d, ANNUAL, [12]))
    return rounded(X.as_observations(got, ["entity"], ["revenue_growth", "roa"], NY), 6)


def _bars(spark, d):
    u = table(spark, d, "universe_lists").where((F.col("close_px") > 0) & (F.col("close_px") < INF) & ~F.isnan("close_px") & F.col("list_date").isNotNull())
    b = u.groupBy("cik", "list_date").agg(F.min("close_px").alias("close"), F.min("dollar_vol").alias("volume"))
    was = F.coalesce(F.lag("close").over(Window.partitionBy("cik").orderBy("list_date")), F.col("close"))
    return b.withColumns({"high": F.greatest("close", was), "low": F.least("close", was)})


def _spreads(spark, d):
    return P.period_spreads(_bars(spark, d), "cik", "list_date", F.year("list_date"), "high", "low", "close", 24, 10, 30)


def spread_periods(spark, d):
    return rounded(_spreads(spark, d).withColumnRenamed("period", "year"), 7)


def cost_bps(spark, d):
    s = table(spark, d, "size_snapshots").select("snap_id", "cik", "as_of")
    return rounded(P.cost_bps(s, "cik", F.year("as_of"), _spreads(spark, d)).select("snap_id", "cost_bps"), 3)


def rebuilt_closes(spark, d):
    """The raw closes as adjusted ones beside their running median as raw ones: jumps that the median doesn't share are chained through."""
    b = _bars(spark, d)
    b = P.rolling_middle(b, "close", ["cik"], ["list_date"], 5, "calm").select("cik", "list_date", F.col("calm").alias("raw"), F.col("close").alias("adjusted"), "high", "low")
    b = P.rescaled(P.rebuilt_adjusted(b, "cik", "list_date", "raw", "adjusted"), "raw", "adjusted", ["high", "low"])
    return rounded(b.select("cik", "list_date", "adjusted", "high", "low"), 5)


def _sized(spark, d):
    """A row a cik and quarter end with its market value, price and volume, ranked by size."""
    u = table(spark, d, "universe_lists").where(F.month("list_date").isin(3, 6, 9, 12) & F.col("code").isNotNull())
    good = lambda c: F.when((F.col(c) > 0) & (F.col(c) < INF), F.col(c))
    u = u.select("list_date", "cik", "code", *[good(c).alias(c) for c in ("close_px", "mcap", "dollar_vol", "shares")]).where("mcap is not null and close_px is not null")
    best = u.groupBy("list_date", "cik").agg(F.max_by(F.struct("code", "close_px", "mcap", "dollar_vol", "shares"), F.struct(F.coalesce("dollar_vol", F.lit(-1.0)), "mcap", "close_px", "code")).alias("b")).select("list_date", "cik", "b.*")
    return best.withColumn("size_rank", F.rank().over(Window.partitionBy("list_date").orderBy(F.col("mcap").desc())))


def small_mid_universe(spark, d):
    got = P.floors(_sized(spark, d), {"mcap": 3e8, "close_px": 5.0, "dollar_vol": 1e6}, rank="size_rank", skip=20)
    return rounded(got.select("list_date", "cik", "code", "size_rank"))


def micro_universe(spark, d):
    got = P.floors(_sized(spark, d), {"mcap": 3e7, "close_px": 1.0, "dollar_vol": 1e5}, {"mcap": 3e8})
    return rounded(got.select("list_date", "cik", "code"))


def large_universe(spark, d):
    """The 50 largest by a value that another source confirms: close times the median share count, against the snapshot of the day."""
    s = P.rolling_middle(_sized(spark, d), "shares", ["cik"], ["list_date"], 5, "med").withColumn("a", F.col("close_px") * F.col("med"))
    b = table(spark, d, "size_snapshots").where("mcap > 0").groupBy("cik", F.col("as_of").alias("list_date")).agg(F.max("mcap").alias("b"))
    s = s.join(b, ["cik", "list_date"], "left").withColumn("turn", F.col("dollar_vol") / F.col("a"))
    s = s.select("list_date", "cik", "close_px", "dollar_vol", P.trusted_value("a", "b", "turn", "close_px", 1.5e12, (0.5, 4.0), 1e-4, 500.0).alias("v")).where("v.value is not null")
    s = s.withColumn("k", F.rank().over(Window.partitionBy("list_date").orderBy(F.col("v.value").desc())))
    return rounded(P.floors(s, {"close_px": 5.0, "dollar_vol": 1e6}, rank="k", top=50).select("list_date", "cik", "k", (F.col("v.value") / 1e6).alias("size"), F.col("v.source").alias("source")), 2)


def insider_windows(spark, d):
    """Events as trades: purchases and views are buys, large ones by officers. Points: each user's errors."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    t = e.where("event_type <> 'error'").select("user_id", "ts", F.pmod("event_id", F.lit(17)).alias("owner"), F.col("event_type").isin("purchase", "view").alias("buy"), (F.col("value") > 50).alias("officer"), F.col("value").alias("usd"))
    got = X.insider_windows(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), "ts", t, "ts", ["user_id"], 7, "event_id", "owner", "buy", "officer", "usd")
    return rounded(got, 6)


QUERIES = {f.__name__: f for f in (annual_ratios, quarterly_features, fundamental_observations, spread_periods, cost_bps, rebuilt_closes, small_mid_universe, micro_universe, large_universe, insider_windows)}


def _sql_facts(concepts, months):
    one = lambda c, n: f"SELECT cik AS entity, list_date AS \"end\", CAST(timezone('{NY}', _available) AS DATE) AS filed, '{n}' AS concept, {c} AS val FROM universe_lists WHERE month(list_date) IN ({', '.join(map(str, months))}) AND _available IS NOT NULL AND {c} > 0 AND {c} < 'Infinity'::DOUBLE AND NOT isnan({c})"
    return f"f AS ({' UNION ALL '.join(one(c, n) for c, n in concepts.items())})"


_PICK = lambda n: f"arg_min(val, {{'a': filed, 'b': val}}) FILTER (concept = '{n}') AS {n}"
_ANN = f"""{_sql_facts(ANNUAL, [12])}, w AS (SELECT entity, "end", max(filed) AS filed, {", ".join(_PICK(n) for n in ANNUAL.values())} FROM f GROUP BY 1, 2),
    a AS (SELECT *, (revenue - lag(revenue) OVER o) / nullif(abs(lag(revenue) OVER o), 0) AS revenue_growth, net_income / nullif(revenue, 0) AS net_margin, net_income / nullif(total_assets, 0) AS roa, (shares - lag(shares) OVER o) / nullif(lag(shares) OVER o, 0) AS share_dilution
          FROM w WINDOW o AS (PARTITION BY entity ORDER BY "end"))"""
_AGO = lambda days, cols, name: f"""{name} AS (SELECT w.entity, w."end", {", ".join(f"arg_min(p.{c}, {{'g': abs(datediff('day', p.\"end\", w.\"end\" - {days})), 'e': p.\"end\"}}) AS {c}" for c in cols)} FROM w JOIN w p ON p.entity = w.entity AND abs(datediff('day', p."end", w."end" - {days})) <= 20 GROUP BY 1, 2)"""
_BARS = f"""u AS (SELECT cik, list_date, min(close_px) AS close FROM universe_lists WHERE close_px > 0 AND close_px < 'Infinity'::DOUBLE AND NOT isnan(close_px) AND list_date IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT *, greatest(close, coalesce(lag(close) OVER o, close)) AS high, least(close, coalesce(lag(close) OVER o, close)) AS low FROM u WINDOW o AS (PARTITION BY cik ORDER BY list_date))"""
_K = "(3 - 2 * sqrt(2::DOUBLE))"
_SPR = f"""{_BARS}, l AS (SELECT cik, list_date, year(list_date) AS year, ln(high) AS h, ln(low) AS l, ln(close) AS c, (ln(high) + ln(low)) / 2 AS m FROM b),
    n AS (SELECT *, lead(h) OVER o AS h1, lead(l) OVER o AS l1, lead(m) OVER o AS m1 FROM l WINDOW o AS (PARTITION BY cik ORDER BY list_date)),
    g AS (SELECT *, pow(h - l, 2) + pow(h1 - l1, 2) AS be, pow(greatest(h, h1) - least(l, l1), 2) AS ga FROM n WHERE true),
    e AS (SELECT *, 4 * (c - m) * (c - m1) AS a1, CASE WHEN h1 IS NOT NULL THEN (sqrt(2 * be) - sqrt(be)) / {_K} - sqrt(ga / {_K}) END AS al FROM g),
    z AS (SELECT cik, list_date, year, a1, CASE WHEN al IS NOT NULL THEN greatest(2 * (exp(al) - 1) / (1 + exp(al)), 0) END AS c1 FROM e),
    y AS (SELECT cik, year, avg(a1) OVER p AS ar, avg(c1) OVER p AS cs, row_number() OVER (PARTITION BY cik ORDER BY list_date) AS k, count(*) OVER (PARTITION BY cik, year) AS n, row_number() OVER (PARTITION BY cik, year ORDER BY list_date DESC) AS last, count(*) OVER (PARTITION BY cik) AS alln
          FROM z WINDOW p AS (PARTITION BY cik ORDER BY list_date ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT cik, year, CASE WHEN k >= 3 THEN sqrt(greatest(ar, 0)) END AS ar, CASE WHEN k >= 3 THEN cs END AS cs FROM y WHERE last = 1 AND n >= 10 AND alln >= 30)"""
_GOOD = lambda c: f"CASE WHEN {c} > 0 AND {c} < 'Infinity'::DOUBLE AND NOT isnan({c}) THEN {c} END AS {c}"
_SIZED = f"""v AS (SELECT list_date, cik, code, {", ".join(map(_GOOD, ("close_px", "mcap", "dollar_vol", "shares")))} FROM universe_lists WHERE month(list_date) IN (3, 6, 9, 12) AND code IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY list_date, cik ORDER BY coalesce(dollar_vol, -1) DESC, mcap DESC, close_px DESC, code DESC) AS n FROM v WHERE mcap IS NOT NULL AND close_px IS NOT NULL),
    z AS (SELECT *, rank() OVER (PARTITION BY list_date ORDER BY mcap DESC) AS size_rank FROM o WHERE n = 1)"""
_DATE = "CAST(list_date AS VARCHAR) AS list_date"
SQL = {
    "annual_ratios": f"""WITH {_ANN} SELECT entity, CAST("end" AS VARCHAR) AS "end", CAST(filed AS VARCHAR) AS filed, {r("revenue_growth", 6)} AS revenue_growth, {r("net_margin", 6)} AS net_margin, {r("roa", 6)} AS roa, NULL::DOUBLE AS gross_margin, {r("share_dilution", 6)} AS share_dilution FROM a""",
    "fundamental_observations": f"""WITH {_ANN}, q AS (SELECT entity, epoch_us(timezone('{NY}', CAST(filed + 1 AS TIMESTAMP))) AS available_at, CAST(datediff('day', DATE '1970-01-01', "end") AS BIGINT) AS seq, unnest(['revenue_growth', 'roa']) AS feature, unnest([revenue_growth, roa]) AS value FROM a)
        SELECT entity, available_at, seq, feature, {r("value", 6)} AS value FROM q WHERE value IS NOT NULL""",
    "quarterly_features": f"""WITH {_sql_facts(QUARTER, [3, 6, 9, 12])}, w0 AS (SELECT entity, "end", max(filed) FILTER (concept IN ('revenue', 'cost_of_revenue')) AS filed, {", ".join(_PICK(n) for n in QUARTER.values())}, min(filed) FILTER (concept = 'rnd') AS rf FROM f GROUP BY 1, 2),
        w1 AS (SELECT entity, "end", filed, revenue, cost_of_revenue AS cogs, inventory, CASE WHEN rf <= filed THEN rnd END AS rnd FROM w0 WHERE filed IS NOT NULL),
        w2 AS (SELECT *, (revenue - cogs) / CASE WHEN revenue > 0 THEN revenue END AS gm, inventory / CASE WHEN cogs > 0 THEN cogs END * 91 AS inv, rnd / CASE WHEN revenue > 0 THEN revenue END AS ri FROM w1),
        w AS (SELECT *, CAST(NULL AS DOUBLE) AS g FROM w2), {_AGO(364, ["revenue", "gm", "inv", "ri"], "yr")}, {_AGO(91, ["revenue"], "qt")},
        x AS (SELECT w.*, w.revenue / CASE WHEN yr.revenue > 0 THEN yr.revenue END - 1 AS yoy, w.revenue / CASE WHEN qt.revenue > 0 THEN qt.revenue END - 1 AS qoq, w.gm - yr.gm AS gmc, w.inv - yr.inv AS invc, w.ri - yr.ri AS ric FROM w LEFT JOIN yr USING (entity, "end") LEFT JOIN qt USING (entity, "end")),
        y AS (SELECT x.entity, x."end", arg_min(p.yoy, {{'g': abs(datediff('day', p."end", x."end" - 364)), 'e': p."end"}}) AS was FROM x JOIN x p ON p.entity = x.entity AND abs(datediff('day', p."end", x."end" - 364)) <= 20 WHERE true GROUP BY 1, 2)
        SELECT x.entity, CAST(x."end" AS VARCHAR) AS "end", CAST(x.filed AS VARCHAR) AS filed, {r("yoy", 6)} AS q_rev_growth_yoy, {r("qoq", 6)} AS q_rev_growth_qoq, {r("gm", 6)} AS q_gross_margin, {r("gmc", 6)} AS q_gross_margin_chg_yoy, NULL::DOUBLE AS q_op_margin, {r("inv", 6)} AS q_inventory_days, {r("invc", 6)} AS q_inventory_days_chg_yoy,
        {r("yoy - y.was", 6)} AS q_rev_growth_yoy_chg4, NULL::DOUBLE AS q_op_margin_chg_yoy, {r("ri", 6)} AS q_rnd_intensity, {r("ric", 6)} AS q_rnd_intensity_chg_yoy FROM x LEFT JOIN y USING (entity, "end")""",
    "spread_periods": f"WITH {_SPR} SELECT cik, year, {r('ar', 7)} AS ar, {r('cs', 7)} AS cs FROM s",
    "cost_bps": f"WITH {_SPR} SELECT snap_id, {r('10000 * CASE WHEN s.ar IS NOT NULL AND s.cs IS NOT NULL THEN (s.ar + s.cs) / 2 ELSE coalesce(s.ar, s.cs) END', 3)} AS cost_bps FROM size_snapshots t LEFT JOIN s ON s.cik = t.cik AND s.year = year(t.as_of)",
    "rebuilt_closes": f"""WITH {_BARS}, m AS (SELECT *, median(close) OVER (PARTITION BY cik ORDER BY list_date ROWS 4 PRECEDING) AS raw FROM b), q AS (SELECT *, close / lag(close) OVER o - 1 AS ra, raw / lag(raw) OVER o - 1 AS rr FROM m WINDOW o AS (PARTITION BY cik ORDER BY list_date)),
        k AS (SELECT *, coalesce((ra > 1 OR ra < -0.5) AND abs(rr) < 0.15, false) AS wrong FROM q), c AS (SELECT *, bool_or(wrong) OVER (PARTITION BY cik) AS bad, first_value(close) OVER o * exp(sum(ln(1 + coalesce(CASE WHEN wrong THEN rr ELSE ra END, 0))) OVER o) AS chained FROM k WINDOW o AS (PARTITION BY cik ORDER BY list_date)),
        a AS (SELECT *, CASE WHEN bad THEN chained ELSE close END AS adj FROM c) SELECT cik, {_DATE}, {r("adj", 5)} AS adjusted, {r("high * adj / raw", 5)} AS high, {r("low * adj / raw", 5)} AS low FROM a""",
    "small_mid_universe": f"WITH {_SIZED} SELECT {_DATE}, cik, code, size_rank FROM z WHERE mcap >= 3e8 AND close_px >= 5 AND dollar_vol >= 1e6 AND size_rank > 20",
    "micro_universe": f"WITH {_SIZED} SELECT {_DATE}, cik, code FROM z WHERE mcap >= 3e7 AND mcap < 3e8 AND close_px >= 1 AND dollar_vol >= 1e5",
    "large_universe": f"""WITH {_SIZED}, m AS (SELECT *, close_px * median(shares) OVER (PARTITION BY cik ORDER BY list_date ROWS 4 PRECEDING) AS a FROM z), bb AS (SELECT cik, as_of AS list_date, max(mcap) AS b FROM size_snapshots WHERE mcap > 0 AND NOT isnan(mcap) GROUP BY 1, 2), j AS (SELECT m.*, bb.b, m.dollar_vol / m.a AS turn FROM m LEFT JOIN bb USING (cik, list_date)),
        t AS (SELECT *, coalesce(b > 0 AND b <= 1.5e12, false) AS bok, coalesce(a <= 1.5e12, false) AS aok FROM j), q AS (SELECT *, CASE WHEN bok AND aok AND a / b BETWEEN 0.5 AND 4.0 THEN 'checked' WHEN bok THEN 'other' WHEN aok AND coalesce(turn, 0) >= 1e-4 AND close_px <= 500 THEN 'unchecked' ELSE 'dropped' END AS source FROM t),
        x AS (SELECT *, CASE source WHEN 'other' THEN b ELSE a END AS size FROM q WHERE source <> 'dropped'), k AS (SELECT *, rank() OVER (PARTITION BY list_date ORDER BY size DESC) AS k FROM x) SELECT {_DATE}, cik, k, {r("size / 1e6", 2)} AS size, source FROM k WHERE close_px >= 5 AND dollar_vol >= 1e6 AND k <= 50""",
    "insider_windows": f"""WITH t AS (SELECT user_id, epoch_us(ts) AS e, event_id % 17 AS owner, event_type IN ('purchase', 'view') AS buy, value > 50 AS officer, value AS usd FROM events WHERE event_type <> 'error'),
        p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
        j AS (SELECT p.event_id, count(DISTINCT owner) FILTER (buy) AS buyers, count(DISTINCT owner) FILTER (NOT buy) AS sellers, count(DISTINCT owner) FILTER (buy AND officer) AS officer_buyers, coalesce(sum(usd) FILTER (buy), 0) AS b, coalesce(sum(usd) FILTER (NOT buy), 0) AS s
              FROM p LEFT JOIN t ON t.user_id = p.user_id AND t.e < p.t AND t.e > p.t - {7 * 86_400_000_000} GROUP BY 1)
        SELECT event_id, buyers, sellers, officer_buyers, {r("CASE WHEN b + s > 0 THEN (b - s) / (b + s) ELSE 0 END", 6)} AS net_share FROM j""",
}
