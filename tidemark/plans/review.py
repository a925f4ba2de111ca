"""Queries of tracking, records of inputs, probes of the reader and checks of base rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import grading as G
from tidemark.operators import ranks as R
from tidemark.operators import tracking as K
from tidemark.plans.common import SCORED, r, rounded, scored_rows, sql_pct
from tidemark.plans.texts import _LV, _S, CHARGE, DEMAND, _docs, _n
from tidemark.session import table

D = "decision_time"
XS = ["x1", "x2"]
WEIGHTS = {"x1": 0.3, "x2": 0.0}
QUESTIONS = {"x1": "outlook", "x2": "demand"}
PROBE = " They booked a one-time charge after the restatement."


def _frame(spark, d):
    s = scored_rows(spark, d).join(table(spark, d, "panel").select("panel_id", "label_end"), "panel_id")
    s = K.tracking_frame(s, "score", "fwd_return", D, "grp", "label_end")
    for x, c in zip(XS, ("score", "rt_cost")):
        s = s.withColumn(x, F.coalesce(R.pct_rank(c, [D]), F.lit(0.5)) - 0.5)
    return s.withColumn("level", F.floor((F.col("x2") + 0.5) * 4.999).cast("double"))


def attribution_joint(spark, d):
    got = K.attribution_table(_frame(spark, d), XS, D, WEIGHTS)
    return rounded(got.select("field", "slope_one", "t_one", "slope_joint", "t_joint", "t_joint_12", "periods", "status"), 5)


def _shapes(spark, d):
    return K.calibration_table(K.cleaned(_frame(spark, d), ["x1"], D), "clean", "level", D)


def calibration_shape(spark, d):
    return rounded(_shapes(spark, d), 5)


def input_decay(spark, d):
    return rounded(K.rolling_ic(_frame(spark, d), XS, "y", D), 6)


def tracking_flags(spark, d):
    """The report's flags of every input. (K6)"""
    f = _frame(spark, d)
    shapes = K.calibration_table(K.cleaned(f, ["x1"], D), "clean", "level", D).withColumn("field", F.lit("x2"))
    got = K.tracking_flags(K.attribution_table(f, XS, D, WEIGHTS), K.rolling_ic(f, XS, "y", D), shapes, {"x2": "demand"}, ["demand"])
    return rounded(got, 5)


def _record(spark, d):
    s = scored_rows(spark, d).join(table(spark, d, "panel").select("panel_id", "label_end"), "panel_id")
    t = K.ic_table(s.withColumns({"x1": F.col("score"), "x2": F.col("rt_cost")}), XS, "fwd_return", D, "grp", "label_end")
    last = s.agg(F.max(D).alias("m")).first().m
    return K.input_record(t, F.lit(last))


def input_record(spark, d):
    return rounded(_record(spark, d))


def question_status(spark, d):
    return rounded(K.question_status(_record(spark, d), QUESTIONS))


def base_rate_leaks(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return K.base_rate_leaks(K.last_used(e, "ts", ["event_type", "user_id"], 2, "event_id"), "ts", "last", 2, ["event_type"])


def _level(text):
    return T.keyword_answer(text, DEMAND)["value"]


def _yes(text):
    return T.keyword_answer(text, CHARGE)["value"]


def reading_invariance(spark, d):
    """Answers to each text and to it in capitals: the reader must not mind."""
    t = _docs(spark, d).where("text is not null").select("doc_id", *[f(c).alias(n) for n, f, c in (("a", _level, F.col("text")), ("b", _level, F.upper("text")), ("p", _yes, F.col("text")), ("q", _yes, F.upper("text")))])
    pairs = t.select(F.explode(F.array(F.struct(F.lit("demand").alias("field"), G.stable(F.col("a"), F.col("b"), "scale").alias("held")), F.struct(F.lit("charge").alias("field"), G.stable(F.col("p"), F.col("q"), "yes_no").alias("held")))).alias("x")).select("x.*")
    return rounded(G.invariance(pairs, "held", ["field"]))


def counterfactual(spark, d):
    """A sentence about a charge is added to texts without one: that answer must move and the other hold."""
    t = _docs(spark, d).where("text is not null").withColumn("edit", F.concat("text", F.lit(PROBE)))
    t = t.select(*[f(F.col(c)).alias(n) for n, f, c in (("a", _level, "text"), ("b", _level, "edit"), ("p", _yes, "text"), ("q", _yes, "edit"))]).where("p < 0.5")
    ok = G.moved(F.col("p"), F.col("q"), True, "yes_no", [G.stable(F.col("a"), F.col("b"), "scale")])
    return rounded(t.agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("passed")))


def identification_gate(spark, d):
    """A guess at each text's kind by the length of the text: every kind whose usual length is nearest shares the top."""
    t = _docs(spark, d).where("text is not null and doc_type is not null").select("doc_type", F.length("text").alias("n"))
    options = F.create_map(F.lit("release"), F.when(F.col("n") > 1000, 0.4).otherwise(0.2), F.lit("note"), F.when(F.col("n") > 1000, 0.4).otherwise(0.2), F.lit("post"), F.when(F.col("n") > 1000, 0.1).otherwise(0.5))
    return rounded(G.identification_gate(t.withColumn("p", options), "p", "doc_type"))


QUERIES = {f.__name__: f for f in (attribution_joint, calibration_shape, input_decay, tracking_flags, input_record, question_status, base_rate_leaks, reading_invariance, counterfactual, identification_gate)}
_PT = lambda v: f"CASE WHEN count({v}) >= 3 AND stddev_samp({v}) > 0 THEN avg({v}) / (stddev_samp({v}) / sqrt(count({v}))) END"
_FR = f"""{SCORED}, k0 AS (SELECT s.*, p.label_end FROM s JOIN panel p USING (panel_id) WHERE s.score IS NOT NULL AND s.fwd_return IS NOT NULL AND p.label_end IS NOT NULL), k1 AS (SELECT *, {sql_pct("fwd_return", D)} AS rr FROM k0),
    k2 AS (SELECT *, round(rr - avg(rr) OVER (PARTITION BY decision_time, grp), 10) AS y, coalesce({sql_pct("score", D)}, 0.5) - 0.5 AS x1, coalesce({sql_pct("rt_cost", D)}, 0.5) - 0.5 AS x2 FROM k1),
    fr AS (SELECT *, round(y - score, 10) AS resid, floor((x2 + 0.5) * 4.999) AS level FROM k2)"""
_AT = f"""{_FR}, q AS (SELECT *, {sql_pct("resid", D)} - 0.5 AS z FROM fr), m AS (SELECT decision_time, count(*) AS n, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c, covar_pop(x1, z) AS c1, covar_pop(x2, z) AS c2 FROM q GROUP BY 1 HAVING count(*) >= 7),
    b AS (SELECT decision_time, row_number() OVER (ORDER BY decision_time DESC) AS k, c1 / nullif(v1, 0) AS o1, c2 / nullif(v2, 0) AS o2, CASE WHEN v1 * v2 - c * c > 1e-12 * v1 * v2 AND v1 > 0 AND v2 > 0 THEN (c1 * v2 - c2 * c) / (v1 * v2 - c * c) WHEN v1 + v2 > 0 THEN c1 / (v1 + v2) ELSE 0 END AS j1, CASE WHEN v1 * v2 - c * c > 1e-12 * v1 * v2 AND v1 > 0 AND v2 > 0 THEN (c2 * v1 - c1 * c) / (v1 * v2 - c * c) WHEN v1 + v2 > 0 THEN c2 / (v1 + v2) ELSE 0 END AS j2 FROM m),
    ll AS (SELECT 'x1' AS field, k, o1 AS o, j1 AS j FROM b UNION ALL SELECT 'x2', k, o2, j2 FROM b), at0 AS (SELECT field, avg(o) AS slope_one, {_PT("o")} AS t_one, avg(j) AS slope_joint, {_PT("j")} AS t_joint, {_PT("CASE WHEN k <= 12 THEN j END")} AS t_joint_12, count(*) AS periods FROM ll GROUP BY 1),
    att AS (SELECT *, CASE WHEN coalesce(abs(t_joint), 0) < 2 THEN 'ok' WHEN field = 'x2' THEN 'missing' WHEN slope_joint > 0 THEN 'under-weighted' ELSE 'over-weighted' END AS status FROM at0)"""
_CA = f"""cs AS (SELECT decision_time, covar_pop(x1, resid) / nullif(var_pop(x1), 0) AS b FROM fr GROUP BY 1), cl AS (SELECT fr.*, fr.resid - coalesce(cs.b, 0) * fr.x1 AS clean FROM fr JOIN cs USING (decision_time)),
    pl AS (SELECT decision_time, level, avg(clean) AS g, count(*) AS c FROM cl GROUP BY 1, 2), dv AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN g - avg(g) OVER w - (avg(level * g) OVER w - avg(level) OVER w * avg(g) OVER w) / nullif(avg(level * level) OVER w - avg(level) OVER w * avg(level) OVER w, 0) * (level - avg(level) OVER w) END AS dev FROM pl WINDOW w AS (PARTITION BY decision_time)),
    sh AS (SELECT level, CAST(sum(c) AS BIGINT) AS n, avg(g) AS gap, {_PT("g")} AS gap_t, avg(dev) AS shape_dev, {_PT("dev")} AS shape_t FROM dv GROUP BY 1)"""
_DE = f"""dl AS (SELECT decision_time, y, unnest(['x1', 'x2']) AS field, unnest([x1, x2]) AS x FROM fr), dr AS (SELECT decision_time, field, {sql_pct("x", "decision_time, field")} AS a, {sql_pct("y", "decision_time, field")} AS b FROM dl), di AS (SELECT decision_time, field, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS rho FROM dr GROUP BY 1, 2),
    dk AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY decision_time DESC) AS k FROM di WHERE rho IS NOT NULL), dm AS (SELECT field, avg(rho) AS ic, {_PT("rho")} AS ic_t, avg(rho) FILTER (k <= 12) AS ic_12, avg(rho) FILTER (k <= 24) AS ic_24, count(*) FILTER (k > 24) AS ne, count(*) FILTER (k <= 24) AS nr, avg(rho) FILTER (k > 24) AS early, avg(rho) FILTER (k <= 24) AS late,
    var_samp(rho) FILTER (k > 24) / count(*) FILTER (k > 24) + var_samp(rho) FILTER (k <= 24) / count(*) FILTER (k <= 24) AS v FROM dk GROUP BY 1), de AS (SELECT *, CASE WHEN ne >= 6 AND nr >= 6 AND v > 0 THEN sign(early) * (late - early) / sqrt(v) END AS decay_t FROM dm)"""
_IT = f"""{SCORED}, j AS (SELECT s.*, p.label_end, round(s.fwd_return - avg(s.fwd_return) OVER (PARTITION BY s.decision_time, s.grp), 10) AS adj FROM s JOIN panel p USING (panel_id)), e AS (SELECT decision_time, max(label_end) AS ended FROM j GROUP BY 1),
    k AS (SELECT decision_time, {sql_pct("adj", D)} AS y, {sql_pct("score", D)} AS x1, {sql_pct("rt_cost", D)} AS x2 FROM j), ul AS (SELECT decision_time, y, unnest(['x1', 'x2']) AS field, unnest([x1, x2]) AS x FROM k), c AS (SELECT decision_time, field, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS ic FROM ul WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
    rec AS (SELECT field, avg(ic) AS ic, {_PT("ic")} AS t, count(*) AS periods FROM c JOIN e USING (decision_time) WHERE ic IS NOT NULL AND ended < (SELECT max(decision_time) FROM s) GROUP BY 1 HAVING count(*) >= 12)"""




def _levels(source: str) -> str:
    """doc_id, lv, p of a source of doc_id, text."""
    yes = f"CASE WHEN {_n(CHARGE.patterns['yes'])} > 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END"
    return f"(WITH {_S.replace('FROM documents', f'FROM ({source})')} SELECT doc_id, {_LV} AS lv, {yes} AS p FROM q)"


SQL = {
    "attribution_joint": f"WITH {_AT} SELECT field, {r('slope_one', 5)} AS slope_one, {r('t_one', 5)} AS t_one, {r('slope_joint', 5)} AS slope_joint, {r('t_joint', 5)} AS t_joint, {r('t_joint_12', 5)} AS t_joint_12, periods, status FROM att",
    "calibration_shape": f"WITH {_FR}, {_CA} SELECT level, n, {r('gap', 5)} AS gap, {r('gap_t', 5)} AS gap_t, {r('shape_dev', 5)} AS shape_dev, {r('shape_t', 5)} AS shape_t FROM sh",
    "input_decay": f"WITH {_FR}, {_DE} SELECT field, {r('ic', 6)} AS ic, {r('ic_t', 6)} AS ic_t, {r('ic_12', 6)} AS ic_12, {r('ic_24', 6)} AS ic_24, {r('decay_t', 6)} AS decay_t, coalesce(decay_t <= -2, false) AS decaying FROM de",
    "tracking_flags": f"WITH {_AT}, {_CA}, {_DE}, mx AS (SELECT 'x2' AS field, max(abs(shape_t)) AS max_shape_t FROM sh) SELECT field, status, {r('t_joint', 5)} AS t_joint, {r('t_one', 5)} AS t_one, coalesce(decay_t <= -2, false) AS decaying, {r('decay_t', 5)} AS decay_t, {r('max_shape_t', 5)} AS max_shape_t, coalesce(max_shape_t >= 2.5, false) AS non_linear, CASE WHEN field = 'x2' THEN 'demand' END AS question, field = 'x2' AS text, field = 'x2' AS misread FROM att JOIN de USING (field) LEFT JOIN mx USING (field)",
    "input_record": f"WITH {_IT} SELECT field, {r('ic')} AS ic, {r('t')} AS t, periods FROM rec",
    "question_status": f"WITH {_IT} SELECT CASE field WHEN 'x1' THEN 'outlook' ELSE 'demand' END AS question, field AS best_field, {r('ic')} AS ic, {r('t')} AS t, CASE WHEN periods < 24 OR coalesce(abs(t), 0) >= 1 THEN 'keep' ELSE 'drop' END AS status FROM rec",
    "base_rate_leaks": f"WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t FROM events), k AS (SELECT event_type, user_id, t + {2 * 86_400_000_000} AS known, max(t) AS last FROM e GROUP BY 1, 2, 3), j AS (SELECT e.event_type, e.t, k.last FROM e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.user_id = k.user_id AND e.t > k.known) SELECT event_type, count(*) AS events, CAST(sum(CASE WHEN t - last <= {2 * 86_400_000_000} THEN 1 ELSE 0 END) AS BIGINT) AS leaks, min(t - last) AS min_gap, sum(CASE WHEN t - last <= {2 * 86_400_000_000} THEN 1 ELSE 0 END) = 0 AS passed FROM j GROUP BY 1",
    "reading_invariance": f"WITH a AS {_levels('SELECT doc_id, text FROM documents WHERE text IS NOT NULL')}, b AS {_levels('SELECT doc_id, upper(text) AS text FROM documents WHERE text IS NOT NULL')}, j AS (SELECT unnest(['demand', 'charge']) AS field, unnest([abs(a.lv - b.lv) < 0.5, abs(a.p - b.p) < 0.1]) AS held FROM a JOIN b USING (doc_id)) SELECT field, count(*) AS n, {r('avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share FROM j GROUP BY 1",
    "counterfactual": f"WITH a AS {_levels('SELECT doc_id, text FROM documents WHERE text IS NOT NULL')}, b AS {_levels(f'SELECT doc_id, text || {chr(39)}{PROBE}{chr(39)} AS text FROM documents WHERE text IS NOT NULL')} SELECT count(*) AS n, {r('avg(CASE WHEN b.p - a.p >= 0.1 - 1e-12 AND abs(a.lv - b.lv) < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS passed FROM a JOIN b USING (doc_id) WHERE a.p < 0.5",
    "identification_gate": f"WITH t AS (SELECT doc_type, length(text) > 1000 AS big FROM documents WHERE text IS NOT NULL AND doc_type IS NOT NULL), g AS (SELECT count(*) AS n, avg(CASE WHEN big AND doc_type IN ('release', 'note') THEN 0.5::DOUBLE WHEN NOT big AND doc_type = 'post' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, 1 / 3::DOUBLE AS chance FROM t) SELECT n, {r('accuracy')} AS accuracy, {r('chance')} AS chance, {r('accuracy - chance')} AS excess, {r('(accuracy - chance) / sqrt(chance * (1 - chance) / n)')} AS z, accuracy - chance <= 0.05 AS passed FROM g",
}
