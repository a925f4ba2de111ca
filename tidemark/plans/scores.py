"""Queries of ranks, scoring and books over the panel's scored rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks as R
from tidemark.operators import scoring as S
from tidemark.plans.common import SCORED, US, r, rounded, scored_rows, sql_pct

D, G = "decision_time", "grp"
MONTHS = [1, 4, 7, 10]


def _q(fn):
    return lambda spark, d: rounded(fn(scored_rows(spark, d)))


def _rows(s):
    return S.book_rows(s, "score", "fwd_return", "rt_cost", D, "entity_id")


def _book(signal):
    return lambda s: S.portfolio(_rows(s), signal(), D, "entity_id")  # columns need a session, so not at import


def _bottom(s):
    return R.pick(s, "score", D, ["panel_id"], count=2, top=False).select("panel_id", D)


def _ic_gain(s):
    a = S.rank_ic(s).select(D, F.col("ic").alias("a"))
    b = S.rank_ic(s.withColumn("base", -F.col("rt_cost")), score="base").select(D, F.col("ic").alias("b"))
    return S.period_t(a.join(b, D).withColumn("gain", F.col("a") - F.col("b")), "gain")


def _overlaps(s):
    days = s.select(D).distinct().agg(F.count("*").alias("n"), F.datediff(F.max(D), F.min(D)).alias("d"))
    return days.select("n", F.greatest(F.lit(1), F.ceil(21 / (F.col("d") * 5 / 7 / F.nullif(F.col("n") - 1, F.lit(0))))).cast("bigint").alias("overlap"))


def _mde(s):
    t = S.rank_ic(s).agg(F.count("ic").alias("n"), F.stddev_samp("ic").alias("sd"))
    return t.select("n", "sd", (F.lit(1.959963984540054 + 0.8416212335729143) * F.col("sd") / F.sqrt("n")).alias("mde"))


QUERIES = {
    "pct_rank_avg_ties": _q(lambda s: s.select("panel_id", R.pct_rank("score", [D, G]).alias("pct"))),
    "rank_features": _q(lambda s: R.centred_ranks(s, ["score", "rt_cost"], D).select("panel_id", "score", "rt_cost")),
    "group_demean": _q(lambda s: s.select("panel_id", R.demean("fwd_return", [D, G]).alias("adjusted"))),
    "winsorize_period": _q(lambda s: R.winsorized(s, "fwd_return", D, 0.05, 0.95).select("panel_id", "fwd_return")),
    "rank_target": _q(lambda s: R.rank_target(s.where(F.col("fwd_return").isNotNull()), "fwd_return", D, G).select("panel_id", "target")),
    "descending_rank": _q(lambda s: s.select("panel_id", R.descending_average_rank("score", [D]).alias("rank"))),
    "decile_edges": _q(lambda s: s.where(F.col("score").isNotNull()).select("panel_id", R.deciles([F.col("score"), F.col("panel_id")], [D]).alias("decile"))),
    "composite_score": _q(lambda s: R.composite(s, ["score", "rt_cost", "fwd_return"], ["score"], D).select("panel_id", "score")),
    "pick_fraction": _q(lambda s: R.pick(s, "score", D, ["panel_id"], fraction=0.1).select("panel_id", D)),
    "pick_count_bottom": _q(_bottom),
    "fill_costs": _q(lambda s: S.fill_costs(s).select("panel_id", "rt_cost")),
    "rank_ic_by_period": _q(lambda s: S.rank_ic(s)),
    "rank_ic_t": _q(lambda s: S.period_t(S.rank_ic(s), "ic")),
    "ic_gain": _q(_ic_gain),
    "newey_west_t": _q(lambda s: S.newey_west_t(S.rank_ic(s), "ic", D, 4)),
    "ic_noise": _q(lambda s: S.ic_noise(s.where(F.col("score").isNotNull()), D)),
    "mde_inputs": _q(_mde),
    "label_overlap": _q(_overlaps),
    "quantile_spread": _q(lambda s: S.quantile_spreads(s, 0.2, 2)),
    "rank_weighted_book": _q(lambda s: S.rank_weighted(s)),
    "band_portfolio": _q(_book(lambda: S.band_signal(0.9, 0.7))),
    "topk_portfolio": _q(_book(lambda: S.top_signal(0.9))),
    "periodic_portfolio": _q(_book(lambda: S.periodic_signal(0.9, MONTHS, D))),
    "book_summary": _q(lambda s: S.book_summary(S.portfolio(_rows(s), S.band_signal(0.9, 0.7), D, "entity_id"))),
}

W = "WITH " + SCORED
_IC = f"""{W}, a AS (SELECT *, fwd_return - avg(fwd_return) OVER (PARTITION BY decision_time, grp) AS adj FROM s), b AS (SELECT * FROM a WHERE score IS NOT NULL AND adj IS NOT NULL),
    c AS (SELECT decision_time, {sql_pct("score", "decision_time")} AS x, {sql_pct("adj", "decision_time")} AS y FROM b),
    ic AS (SELECT decision_time, count(*) AS n, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS ic FROM c GROUP BY 1)"""
_T = "count(v) AS n, {m} AS mean, {t} AS t"


def _sql_t(v: str, src: str) -> str:
    t = f"CASE WHEN count({v}) >= 3 AND stddev_samp({v}) > 0 THEN avg({v}) / (stddev_samp({v}) / sqrt(count({v}))) END"
    return f" SELECT count({v}) AS n, {r(f'avg({v})')} AS mean, {r(t)} AS t FROM {src}"


def _sql_book(signal: str) -> str:
    return f"""{W}, d AS (SELECT decision_time, entity_id, fwd_return AS ret, rt_cost AS cost, {sql_pct("score", "decision_time")} AS pct FROM s WHERE score IS NOT NULL),
    t AS (SELECT decision_time, row_number() OVER (ORDER BY decision_time) AS k FROM (SELECT DISTINCT decision_time FROM d)),
    f AS (SELECT entity_id, min(k) AS a FROM d JOIN t USING (decision_time) GROUP BY 1),
    g AS (SELECT f.entity_id, t.k, t.decision_time, d.ret, d.cost, d.pct FROM f JOIN t ON t.k >= f.a LEFT JOIN d ON d.entity_id = f.entity_id AND d.decision_time = t.decision_time),
    h AS (SELECT *, {signal} AS sig FROM g),
    i AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held,
          last_value(cost IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM h),
    j AS (SELECT *, lag(held, 1, 0) OVER (PARTITION BY entity_id ORDER BY k) AS was FROM i),
    m AS (SELECT k, avg(ret) AS mean, median(cost) AS med, sum(held) AS n FROM j GROUP BY 1),
    jj AS (SELECT *, last_value(CASE WHEN held = 1 AND was = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM j),
    b AS (SELECT jj.decision_time, CAST(m.n AS BIGINT) AS n, sum(CASE WHEN held = 1 THEN coalesce(ret, mean) - mean ELSE 0 END) / greatest(m.n, 1) AS gross,
          sum(CASE WHEN held = 1 AND was = 0 THEN coalesce(cost, med) WHEN held = 0 AND was = 1 THEN coalesce(old, med) ELSE 0 END) * 0.5 / greatest(m.n, 1) AS cost
          , sum(CASE WHEN held <> was THEN 0.5::DOUBLE ELSE 0 END) / greatest(m.n, 1) AS turnover, count(CASE WHEN held = 0 AND was = 1 THEN 1 END) AS closed, CAST(coalesce(sum(CASE WHEN held = 0 AND was = 1 THEN k - since END), 0) AS BIGINT) AS closed_periods
          FROM jj JOIN m USING (k) WHERE m.n > 0 GROUP BY 1, 2, m.n)"""


_BAND = "CASE WHEN pct > 0.9 THEN 1 WHEN pct IS NULL OR pct <= 0.7 THEN 0 END"
_BOOK_OUT = f" SELECT {US}, n, {r('gross')} AS gross, {r('cost')} AS cost, {r('gross - cost')} AS net, {r('turnover')} AS turnover, closed, closed_periods FROM b"
_UTCMONTH = "month(timezone('UTC', decision_time))"
SQL = {
    "pct_rank_avg_ties": f"{W} SELECT panel_id, {r(sql_pct('score', 'decision_time, grp'))} AS pct FROM s",
    "rank_features": f"{W} SELECT panel_id, {r('coalesce(' + sql_pct('score', 'decision_time') + ', 0.5) - 0.5')} AS score, {r('coalesce(' + sql_pct('rt_cost', 'decision_time') + ', 0.5) - 0.5')} AS rt_cost FROM s",
    "group_demean": f"{W} SELECT panel_id, {r('fwd_return - avg(fwd_return) OVER (PARTITION BY decision_time, grp)')} AS adjusted FROM s",
    "winsorize_period": f"{W}, q AS (SELECT decision_time, quantile_cont(fwd_return, 0.05) AS a, quantile_cont(fwd_return, 0.95) AS b FROM s GROUP BY 1) SELECT panel_id, CASE WHEN fwd_return IS NOT NULL THEN {r('greatest(least(fwd_return, b), a)')} END AS fwd_return FROM s JOIN q USING (decision_time)",
    "rank_target": f"{W}, t AS (SELECT * FROM s WHERE fwd_return IS NOT NULL) SELECT panel_id, {r(sql_pct('fwd_return', 'decision_time, grp') + ' - 0.5')} AS target FROM t",
    "descending_rank": f"{W} SELECT panel_id, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY decision_time ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY decision_time, score) - 1) / 2.0 END AS rank FROM s",
    "decile_edges": f"{W}, t AS (SELECT panel_id, count(*) OVER (PARTITION BY decision_time) AS n, row_number() OVER (PARTITION BY decision_time ORDER BY score, panel_id) AS rn FROM s WHERE score IS NOT NULL) SELECT panel_id, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(0, ceil((rn - 1) * 10 / greatest(n - 1, 1)) - 1) END AS BIGINT) AS decile FROM t",
    "composite_score": f"{W}, t AS (SELECT * FROM s WHERE score IS NOT NULL) SELECT panel_id, {r('(' + ' + '.join(f'coalesce({sql_pct(x, D)}, 0.5)' for x in ('score', 'rt_cost', 'fwd_return')) + ') / 3')} AS score FROM t",
    "pick_fraction": f"{W}, t AS (SELECT panel_id, decision_time, row_number() OVER (PARTITION BY decision_time ORDER BY score DESC, panel_id) AS rn, greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY decision_time), 0)) AS n FROM s WHERE score IS NOT NULL) SELECT panel_id, {US} FROM t WHERE rn <= n",
    "pick_count_bottom": f"{W}, t AS (SELECT panel_id, decision_time, row_number() OVER (PARTITION BY decision_time ORDER BY score, panel_id) AS rn FROM s WHERE score IS NOT NULL) SELECT panel_id, {US} FROM t WHERE rn <= 2",
    "fill_costs": f"{W} SELECT panel_id, {r('coalesce(rt_cost, (SELECT median(rt_cost) FROM s))')} AS rt_cost FROM s",
    "rank_ic_by_period": f"{_IC} SELECT {US}, n, {r('ic')} AS ic FROM ic",
    "rank_ic_t": _IC + _sql_t("ic", "ic"),
    "ic_gain": _IC
    + f""", b2 AS (SELECT decision_time, -rt_cost AS z, adj FROM a WHERE rt_cost IS NOT NULL AND adj IS NOT NULL), c2 AS (SELECT decision_time, {sql_pct("z", "decision_time")} AS x, {sql_pct("adj", "decision_time")} AS y FROM b2),
    ic2 AS (SELECT decision_time, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS ic2 FROM c2 GROUP BY 1), gg AS (SELECT ic.ic - ic2.ic2 AS gain FROM ic JOIN ic2 USING (decision_time))"""
    + _sql_t("gain", "gg"),
    "newey_west_t": _IC
    + f""", e AS (SELECT decision_time, ic - (SELECT avg(ic) FROM ic) AS e FROM ic WHERE ic IS NOT NULL),
    f AS (SELECT e, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3, lag(e, 4) OVER w AS l4 FROM e WINDOW w AS (ORDER BY decision_time)),
    v AS (SELECT count(*) AS n, sum(e * e) + 1.6 * coalesce(sum(e * l1), 0) + 1.2 * coalesce(sum(e * l2), 0) + 0.8 * coalesce(sum(e * l3), 0) + 0.4 * coalesce(sum(e * l4), 0) AS var FROM f)
    SELECT n, {r("(SELECT avg(ic) FROM ic)")} AS mean, CASE WHEN n >= 3 AND var > 0 THEN {r("(SELECT avg(ic) FROM ic) / sqrt(var / n / n)")} END AS t FROM v""",
    "ic_noise": f"{W}, n AS (SELECT count(*) AS n FROM s WHERE score IS NOT NULL GROUP BY decision_time) SELECT {r('sqrt(avg(1.0 / (n - 1)))')} AS sd FROM n WHERE n > 1",
    "mde_inputs": f"{_IC} SELECT count(ic) AS n, {r('stddev_samp(ic)')} AS sd, {r('(1.959963984540054 + 0.8416212335729143) * stddev_samp(ic) / sqrt(count(ic))')} AS mde FROM ic",
    "label_overlap": f"{W}, x AS (SELECT count(DISTINCT decision_time) AS n, datediff('day', timezone('UTC', min(decision_time)), timezone('UTC', max(decision_time))) AS d FROM s) SELECT n, CAST(greatest(1, ceil(21 / (d * 5 / 7 / nullif(n - 1, 0)))) AS BIGINT) AS overlap FROM x",
    "quantile_spread": f"""{W}, d AS (SELECT decision_time, grp, entity_id, fwd_return, rt_cost, {sql_pct("score", "decision_time, grp")} AS p FROM s WHERE score IS NOT NULL AND fwd_return IS NOT NULL),
    e AS (SELECT *, CASE WHEN p > 1 - 0.2 THEN 'top' WHEN p <= 0.2 THEN 'bottom' END AS leg FROM d),
    f AS (SELECT *, count(CASE WHEN leg = 'top' THEN 1 END) OVER (PARTITION BY decision_time, grp) AS nt, count(CASE WHEN leg = 'bottom' THEN 1 END) OVER (PARTITION BY decision_time, grp) AS nb FROM e WHERE leg IS NOT NULL),
    g AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY decision_time) AS k FROM f WHERE nt >= 2 AND nb >= 2),
    h AS (SELECT g.*, w.k IS NULL AS fresh FROM g LEFT JOIN g w ON w.grp = g.grp AND w.leg = g.leg AND w.entity_id = g.entity_id AND w.k = g.k - 1),
    i AS (SELECT decision_time, grp, leg, avg(fwd_return) AS rr, avg(CASE WHEN fresh THEN 1.0 ELSE 0.0 END) AS share, coalesce(avg(CASE WHEN fresh THEN rt_cost END), 0) AS c FROM h GROUP BY 1, 2, 3),
    j AS (SELECT decision_time, grp, sum(CASE WHEN leg = 'top' THEN rr ELSE -rr END) AS gross, sum(share * c) AS cost, avg(share) AS turnover FROM i GROUP BY 1, 2)
    SELECT {US}, {r("avg(gross)")} AS gross, {r("avg(cost)")} AS cost, {r("avg(turnover)")} AS turnover, {r("avg(gross) - avg(cost)")} AS net FROM j GROUP BY j.decision_time""",
    "rank_weighted_book": f"""{W}, d AS (SELECT decision_time, grp, entity_id, fwd_return, rt_cost, {sql_pct("score", "decision_time, grp")} AS p FROM s WHERE score IS NOT NULL AND fwd_return IS NOT NULL),
    e AS (SELECT *, p - avg(p) OVER (PARTITION BY decision_time, grp) AS c FROM d),
    f AS (SELECT *, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY decision_time) / 2, 0), 0) AS w, dense_rank() OVER (ORDER BY decision_time) AS k FROM e),
    m AS (SELECT k, decision_time, median(rt_cost) AS med FROM f GROUP BY 1, 2),
    b AS (SELECT coalesce(n.k, o.k + 1) AS k, coalesce(n.w, 0) AS w, coalesce(o.w, 0) AS w0, n.fwd_return, n.rt_cost FROM f n FULL JOIN f o ON n.entity_id = o.entity_id AND n.k = o.k + 1)
    SELECT {US}, {r("sum(w * fwd_return)")} AS gross, {r("sum(0.5 * abs(w - w0) * coalesce(rt_cost, med))")} AS cost, {r("0.5 * sum(abs(w - w0))")} AS turnover, {r("sum(w * fwd_return) - sum(0.5 * abs(w - w0) * coalesce(rt_cost, med))")} AS net
    FROM b JOIN m USING (k) GROUP BY m.decision_time""",
    "band_portfolio": _sql_book(_BAND) + _BOOK_OUT,
    "topk_portfolio": _sql_book("CASE WHEN pct > 0.9 THEN 1 ELSE 0 END") + _BOOK_OUT,
    "periodic_portfolio": _sql_book(f"CASE WHEN {_UTCMONTH} IN (1, 4, 7, 10) THEN CASE WHEN coalesce(pct > 0.9, false) THEN 1 ELSE 0 END END") + _BOOK_OUT,
    "book_summary": _sql_book(_BAND)
    + f""", z AS (SELECT gross, cost, gross - cost AS net, turnover, closed, closed_periods FROM b) SELECT count(net) AS periods, {r("avg(gross)")} AS gross, {r("12 * avg(turnover)")} AS turnover, {r("sum(closed_periods) / nullif(sum(closed), 0)")} AS holding, {r("avg(net)")} AS mean, {r("CASE WHEN count(net) >= 3 AND stddev_samp(net) > 0 THEN avg(net) / (stddev_samp(net) / sqrt(count(net))) END")} AS t, {r("sum(cost) / nullif(abs(sum(gross)), 0)")} AS lost FROM z""",
}
