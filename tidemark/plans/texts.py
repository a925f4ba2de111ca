"""Queries of the text path, grading, tracking and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import asof as A
from tidemark.operators import grading as G
from tidemark.operators import ranks as R
from tidemark.operators import ridge as M
from tidemark.operators import scoring as S
from tidemark.plans.common import SCORED, r, rounded, scored_rows, sql_pct
from tidemark.plans.features import XS, _model
from tidemark.session import table

D = "decision_time"
OUTLOOK = T.Question("outlook", "choice", "What does the outlook say?", ("raised", "lowered", "kept"), {"raised": "raised|increase|higher", "lowered": "lowered|decrease|weak", "kept": "maintain|unchanged|steady"}, "kept")
DEMAND = T.Question("demand", "scale", "How strong is demand?", (), {"0": "collapse|halted", "1": "soft|weak|slipped", "2": "patchy|mixed", "3": "steady|firm", "4": "strong|record"})
CHARGE = T.Question("charge", "yes_no", "Is there a one-off charge?", (), {"yes": "one-time|one-off|restate"})


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "entity_id", "available_at", "doc_type", "lang", "text")


def keyword_yes_no(spark, d):
    a = _docs(spark, d).select("doc_id", T.keyword_answer(F.col("text"), CHARGE).alias("a"))
    return rounded(a.select("doc_id", F.col("a.value").alias("p"), F.lower("a.evidence").alias("evidence")))


def keyword_choice(spark, d):
    a = _docs(spark, d).select("doc_id", T.keyword_answer(F.col("text"), OUTLOOK).alias("a"))
    return rounded(a.select("doc_id", *[F.col("a.probs")[k].alias(k) for k in OUTLOOK.options]))


def keyword_scale(spark, d):
    a = _docs(spark, d).select("doc_id", T.keyword_answer(F.col("text"), DEMAND).alias("a"))
    return rounded(a.select("doc_id", F.col("a.value").alias("level"), T.encode_scale(F.col("a.probs"))["sd"].alias("sd")), 6)


def quote_ok(spark, d):
    """A quote from each text itself, in capitals with wider blanks, and one with its letters turned round."""
    t = _docs(spark, d).where("text is not null").withColumn("q", F.substring("text", 31, 60))
    loose = F.replace(F.translate("q", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), F.lit("  "))
    return t.select("doc_id", T.quote_ok(loose, F.col("text")).alias("own"), T.quote_ok(F.reverse("q"), F.col("text")).alias("turned"))


def answer_change(spark, d):
    a = _docs(spark, d).where("available_at is not null").select("doc_id", "entity_id", "doc_type", "available_at", T.keyword_answer(F.col("text"), DEMAND)["value"].alias("level"))
    return rounded(T.expected_previous(a, "level", ["entity_id", "doc_type"], ["available_at", "doc_id"], 4, 2).select("doc_id", "level_chg"), 6)


def answers_to_observations(spark, d):
    a = _docs(spark, d).where("text is not null").select("doc_id", "entity_id", T.keyword_answer(F.col("text"), DEMAND)["value"].alias("demand"), T.keyword_answer(F.col("text"), CHARGE)["value"].alias("charge"))
    return rounded(T.to_observations(a, ["entity_id"], ["demand", "charge"], "doc_id"), 6)


def mask_names(spark, d):
    names = table(spark, d, "universe_lists").where("code is not null").groupBy("code").agg(F.min("company_name").alias("name"))
    t = _docs(spark, d).where("text is not null").join(names, F.col("entity_id") == F.col("code"), "left")
    m = t.select("doc_id", T.mask(F.col("text"), F.col("name"), F.col("code")).alias("m"))
    return m.select("doc_id", F.md5("m").alias("masked"))


def page_text(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(T.page_text(F.col("text"))).alias("plain"))


def trigram_lift(spark, d):
    t = _docs(spark, d).where("text is not null").withColumn("target", F.col("doc_type") == "filing_card").where("target is not null")
    return rounded(T.phrase_lift(t, "doc_id", "text", "target", 0.02), 7)


def unread_documents(spark, d):
    t = _docs(spark, d).withColumn("key", T.answer_key("keyword-1", CHARGE, F.col("text")))
    cache = t.where("doc_type = 'release'").select("key")
    return T.unread(t, cache, "key").select("doc_id", "key")


def asof_reading(spark, d):
    """Latest reading before each decision."""
    a = _docs(spark, d).where("text is not null").select("doc_id", "entity_id", "available_at", T.keyword_answer(F.col("text"), DEMAND)["value"].alias("level"))
    p = table(spark, d, "panel").select("panel_id", "entity_id", D)
    return rounded(A.asof(p, D, a, "available_at", ["entity_id"], "doc_id", ["level"], max_age_days=365).select("panel_id", "level"), 6)


def _graded(s):
    s = s.where("score is not null and fwd_return is not null")
    return s.select("*", R.pct_rank("score", [D]).alias("p"), (F.col("fwd_return") > 0).cast("double").alias("y"), (F.col("fwd_return") > 0).alias("up"))


def brier_skill(spark, d):
    return rounded(G.brier_skill(_graded(scored_rows(spark, d)), "p", "y", ["block"]))


def choice_skill(spark, d):
    s = _graded(scored_rows(spark, d)).select(F.when(F.col("up"), "up").otherwise("down").alias("l"), F.col("p").alias("pu"), (1 - F.col("p")).alias("pd"))
    return rounded(G.choice_skill(s, [("up", "pu"), ("down", "pd")], "l"))


def tolerance_skill(spark, d):
    s = _graded(scored_rows(spark, d)).select(F.floor(F.col("p") * 4.999).cast("double").alias("lvl"), F.floor(R.pct_rank("fwd_return", [D]) * 4.999).cast("double").alias("y"))
    return rounded(G.tolerance_skill(s, "lvl", "y"))


def auc_rank(spark, d):
    return rounded(G.auc(_graded(scored_rows(spark, d)), "score", "up"))


def agreement(spark, d):
    s = _graded(scored_rows(spark, d)).withColumn("call", F.col("p") > 0.5)
    return rounded(G.agreement(s, "call", "up", ["grp"]))


def reading_stability(spark, d):
    s = scored_rows(spark, d)
    w = Window.partitionBy("entity_id").orderBy(D)
    return rounded(s.select("entity_id", G.stable(F.col("score"), F.lag("score").over(w), "scale").alias("ok")).where("ok is not null").groupBy("entity_id").agg(F.avg(F.col("ok").cast("double")).alias("share")))


def coverage(spark, d):
    return rounded(G.coverage(scored_rows(spark, d), ["score", "fwd_return", "rt_cost"]))


def identification(spark, d):
    docs = _docs(spark, d).where("text is not null").withColumn("guess", F.when(F.col("text").contains("revenue of"), "release").otherwise("note"))
    return rounded(G.identification(docs.withColumn("ties", F.lit(1)), "guess", "doc_type", "ties", 5))


def reaction_power(spark, d):
    s, g = _model(spark, d)
    fits = M.out_of_fold(g, lambda t: t.year)
    s = M.model_rows(s, "fwd_return", D, "grp")
    w = M.apply_weights(s, XS, D, {t: fits[t.year] for t in set(g.times)}).withColumnRenamed("score", "fit")
    return rounded(G.spearman(w.withColumn("year", F.year(D)), "fit", "target", ["year"]))


def _resid(spark, d):
    """Residuals of all closed labels."""
    p = table(spark, d, "panel").select("panel_id", "label_end")
    s = scored_rows(spark, d).join(p, "panel_id")
    s = G.residual_frame(s, "score", "fwd_return", D, "grp", "label_end", F.timestamp_micros(F.lit(2**62)))
    return s.withColumn("x1", F.coalesce(R.pct_rank("score", [D]), F.lit(0.5)) - 0.5).withColumn("x2", F.coalesce(R.pct_rank("rt_cost", [D]), F.lit(0.5)) - 0.5)


def attribution_slopes(spark, d):
    return rounded(G.attribution(_resid(spark, d), ["x1", "x2"], D, {"x1": 0.3, "x2": 0.0}))


def calibration_levels(spark, d):
    s = _resid(spark, d).withColumn("level", F.floor((F.col("x2") + 0.5) * 4.999).cast("double"))
    return rounded(G.calibration(s, "level", D))


def rolling_ic_decay(spark, d):
    return rounded(G.decay(S.rank_ic(scored_rows(spark, d)), D, 12))


def batches_by_id(spark, d):
    s = scored_rows(spark, d).where("score is not null")
    return rounded(G.batches(s, [D, "grp"], "panel_id", 5).select("panel_id", "batch"))


def batch_pick(spark, d):
    b = G.batches(scored_rows(spark, d).where("score is not null"), [D, "grp"], "panel_id", 5)
    w = Window.partitionBy(D, "grp", "batch").orderBy(F.col("score").desc(), "panel_id")
    return rounded(b.withColumn("k", F.row_number().over(w)).where("k = 1").select("panel_id", "batch"))


def grade_decisions(spark, d):
    b = G.batches(scored_rows(spark, d).where("score is not null"), [D, "grp"], "panel_id", 5)
    w = Window.partitionBy(D, "grp", "batch").orderBy(F.col("score").desc(), "panel_id")
    return rounded(G.grade_picks(b.withColumn("picked", F.row_number().over(w) == 1), "picked", "fwd_return", D))


def decision_cards(spark, d):
    s = scored_rows(spark, d)
    return s.select("panel_id", G.cards(s, ["score", "rt_cost"], 2).alias("card"))


def ic_table(spark, d):
    s = scored_rows(spark, d).select(D, "fwd_return", "score", "rt_cost").unpivot([D, "fwd_return"], ["score", "rt_cost"], "field", "x")
    ic = G.spearman(s, "x", "fwd_return", [D, "field"])
    n, m, sd = F.count("rho"), F.avg("rho"), F.stddev_samp("rho")
    return rounded(ic.groupBy("field").agg(n.alias("periods"), m.alias("ic"), F.when((n >= 12) & (sd > 0), m / (sd / F.sqrt(n))).alias("t")))


def override_split(spark, d):
    """Picks by the cheaper name against the model's own, by the inputs that led the picked card."""
    b = G.batches(scored_rows(spark, d).where("score is not null"), [D, "grp"], "panel_id", 5)
    w = Window.partitionBy(D, "grp", "batch")
    b = b.withColumns({"mean": F.avg("fwd_return").over(w), "m": F.row_number().over(w.orderBy(F.col("score").desc(), "panel_id")), "k": F.row_number().over(w.orderBy(F.col("rt_cost").asc_nulls_last(), "panel_id"))})
    model, pick = F.when(F.col("m") == 1, F.col("fwd_return") - F.col("mean")), F.when(F.col("k") == 1, F.col("fwd_return") - F.col("mean"))
    lead = F.when(F.col("k") == 1, F.when(F.abs("score") >= 1, F.array(F.lit("score"), F.lit("rt_cost"))).otherwise(F.array(F.lit("rt_cost"))))
    got = b.groupBy(D, "grp", "batch").agg(F.max(F.when(F.col("k") == 1, F.col("m"))).alias("m"), F.max(model).alias("model"), F.max(pick).alias("pick"), F.max(lead).alias("fields"))
    return rounded(G.override_split(got.where("m > 1 and model is not null and pick is not null"), "fields", "pick", "model", D))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_yes_no, keyword_choice, keyword_scale, quote_ok, answer_change, answers_to_observations, mask_names, page_text, trigram_lift, unread_documents, asof_reading,
        brier_skill, choice_skill, tolerance_skill, auc_rank, agreement, reading_stability, coverage, identification, reaction_power, attribution_slopes, calibration_levels,
        rolling_ic_decay, batches_by_id, batch_pick, grade_decisions, decision_cards, ic_table, override_split,
    )
}


def _n(p: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '(?i){p}'))"


def _at(p: str) -> str:
    return f"CASE WHEN {_n(p)} > 0 THEN length(regexp_extract(coalesce(text, ''), '(?is)^(.*?)(?:{p})', 1)) ELSE -1 END"


def _best(q: T.Question) -> str:
    keys = [k for k in q.keys() if k in q.patterns]
    s = ", ".join(f"struct_pack(n := -{_n(q.patterns[k])}, p := {_at(q.patterns[k])}, i := {i}, k := '{k}')" for i, k in enumerate(keys))
    return f"list_min([{s}])"


_C = f"c AS (SELECT *, {_best(OUTLOOK)} AS b FROM documents)"
_S = f"c AS (SELECT *, {_best(DEMAND)} AS b FROM documents), q AS (SELECT *, CASE WHEN b.n < 0 THEN b.k ELSE '2' END AS top, CASE WHEN b.n < 0 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS m FROM c)"
_PR = lambda k: f"(CASE WHEN top = '{k}' THEN m ELSE (1 - m) / 4 END)"
_LV = "(" + " + ".join(f"{k} * {_PR(k)}" for k in range(5)) + ")"
_SQ = "(" + " + ".join(f"{k * k} * {_PR(k)}" for k in range(5)) + ")"
_YES = f"CASE WHEN {_n(CHARGE.patterns['yes'])} > 0 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE END"
_GR = f"{SCORED}, g AS (SELECT *, {sql_pct('score', D)} AS p, CASE WHEN fwd_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, fwd_return > 0 AS up FROM s WHERE score IS NOT NULL AND fwd_return IS NOT NULL)"
_RES = f"""{SCORED}, j AS (SELECT s.*, round(s.fwd_return - avg(s.fwd_return) OVER (PARTITION BY s.decision_time, s.grp), 10) AS adj FROM s JOIN panel p ON p.panel_id = s.panel_id WHERE p.label_end IS NOT NULL AND score IS NOT NULL AND fwd_return IS NOT NULL),
    w AS (SELECT *, {sql_pct('adj', D)} - {sql_pct('score', D)} AS resid, coalesce({sql_pct('score', D)}, 0.5) - 0.5 AS x1, coalesce({sql_pct('rt_cost', D)}, 0.5) - 0.5 AS x2 FROM j)"""
_TT = lambda v: f"CASE WHEN count({v}) >= 3 AND stddev_samp({v}) > 0 THEN avg({v}) / (stddev_samp({v}) / sqrt(count({v}))) END"
_BA = f"{SCORED}, t AS (SELECT *, (row_number() OVER (PARTITION BY decision_time, grp ORDER BY panel_id) - 1) // 5 AS batch FROM s WHERE score IS NOT NULL), b AS (SELECT *, count(*) OVER (PARTITION BY decision_time, grp, batch) AS n FROM t), f AS (SELECT *, row_number() OVER (PARTITION BY decision_time, grp, batch ORDER BY score DESC, panel_id) AS k FROM b WHERE n = 5)"
_FW = "regexp_extract(name, '^([A-Za-z0-9]+)', 1)"
_FLAT = lambda c: f"trim(regexp_replace(lower({c}), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"
SQL = {
    "keyword_yes_no": f"SELECT doc_id, {r(_YES)} AS p, lower(nullif(regexp_extract(coalesce(text, ''), '(?i){CHARGE.patterns['yes']}', 0), '')) AS evidence FROM documents",
    "keyword_choice": f"WITH {_C}, q AS (SELECT doc_id, CASE WHEN b.n < 0 THEN b.k ELSE 'kept' END AS top, CASE WHEN b.n < 0 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS m FROM c) SELECT doc_id, " + ", ".join(f"{r(f'CASE WHEN top = {chr(39)}{k}{chr(39)} THEN m ELSE (1 - m) / 2 END')} AS {k}" for k in OUTLOOK.options) + " FROM q",
    "keyword_scale": f"WITH {_S} SELECT doc_id, {r(_LV, 6)} AS level, {r(f'sqrt(greatest({_SQ} - {_LV} * {_LV}, 0))', 6)} AS sd FROM q",
    "quote_ok": f"WITH t AS (SELECT doc_id, {_FLAT('text')} AS f, substr(text, 31, 60) AS q FROM documents WHERE text IS NOT NULL) SELECT doc_id, contains(f, {_FLAT("replace(translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '  ')")}) AS own, contains(f, {_FLAT('reverse(q)')}) AS turned FROM t",
    "answer_change": f"WITH {_S}, a AS (SELECT *, {_LV} AS lv FROM q WHERE available_at IS NOT NULL) SELECT doc_id, {r('lv - CASE WHEN count(lv) OVER w >= 2 THEN avg(lv) OVER w END', 6)} AS level_chg FROM a WINDOW w AS (PARTITION BY entity_id, doc_type ORDER BY available_at, doc_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "answers_to_observations": f"WITH {_S} SELECT entity_id, doc_id, 'demand' AS feature, {r(_LV, 6)} AS value FROM q WHERE text IS NOT NULL UNION ALL SELECT entity_id, doc_id, 'charge', {r(_YES, 6)} FROM q WHERE text IS NOT NULL",
    "mask_names": f"""WITH n AS (SELECT code, min(company_name) AS name FROM universe_lists WHERE code IS NOT NULL GROUP BY 1), t AS (SELECT d.doc_id, d.text, n.name, n.code FROM documents d LEFT JOIN n ON d.entity_id = n.code WHERE d.text IS NOT NULL),
        a AS (SELECT *, CASE WHEN name IS NOT NULL THEN replace(text, name, 'COMPANY') ELSE text END AS x FROM t), b AS (SELECT *, CASE WHEN code IS NOT NULL AND regexp_matches(code, '^[A-Za-z0-9]+$') THEN regexp_replace(x, '(^|[^A-Za-z0-9])' || code || '($|[^A-Za-z0-9])', '\\1TICKER\\2', 'g') ELSE x END AS y FROM a)
        SELECT doc_id, md5(CASE WHEN coalesce(length({_FW}), 0) >= 4 THEN regexp_replace(y, '(?i)(^|[^A-Za-z0-9])' || {_FW} || '($|[^A-Za-z0-9])', '\\1COMPANY\\2', 'g') ELSE y END) AS masked FROM b""",
    "page_text": """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
        b AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS t FROM a) SELECT doc_id, md5(trim(regexp_replace(t, '(?s)SIGNATURES? .*$', ''), ' ')) AS plain FROM b""",
    "trigram_lift": f"""WITH d AS (SELECT doc_id, text, doc_type = 'filing_card' AS target FROM documents WHERE text IS NOT NULL AND doc_type IS NOT NULL), n AS (SELECT count(*) FILTER (target) AS i, count(*) FILTER (NOT target) AS o FROM d),
        s AS (SELECT doc_id, target, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM d), w AS (SELECT doc_id, target, regexp_extract_all(lower(s), '[a-z][a-z-]*') AS w FROM s),
        g AS (SELECT DISTINCT doc_id, target, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS gram FROM w WHERE len(w) >= 3),
        c AS (SELECT gram, count(*) FILTER (target) / nullif((SELECT i FROM n), 0) AS inside, count(*) FILTER (NOT target) / nullif((SELECT o FROM n), 0) AS outside FROM g GROUP BY 1)
        SELECT gram, {r('inside', 7)} AS inside, {r('outside', 7)} AS outside, {r('coalesce(inside, 0) - coalesce(outside, 0)', 7)} AS lift FROM c WHERE coalesce(inside, 0) - coalesce(outside, 0) > 0.02""",
    "unread_documents": f"WITH k AS (SELECT doc_id, doc_type, sha256('keyword-1' || chr(0) || 'charge@1' || chr(0) || '{CHARGE.wording}' || chr(0) || coalesce(text, '') || chr(0)) AS key FROM documents) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_type = 'release')",
    "asof_reading": f"WITH {_S}, a AS (SELECT entity_id, epoch_us(available_at) AS t, arg_max({_LV}, doc_id) AS lv FROM q WHERE text IS NOT NULL AND available_at IS NOT NULL GROUP BY 1, 2), p AS (SELECT panel_id, entity_id, epoch_us(decision_time) AS t FROM panel), j AS (SELECT p.panel_id, a.lv, p.t - a.t AS age FROM p ASOF LEFT JOIN a ON p.entity_id = a.entity_id AND p.t > a.t) SELECT panel_id, CASE WHEN age <= {365 * 86_400_000_000} THEN {r('lv', 6)} END AS level FROM j",
    "brier_skill": f"WITH {_GR} SELECT CAST(block AS BIGINT) AS block, count(*) AS n, {r('CASE WHEN avg(y) - avg(y) * avg(y) > 1e-12 THEN 1 - avg((p - y) * (p - y)) / (avg(y) - avg(y) * avg(y)) WHEN avg((p - y) * (p - y)) <= 1e-12 THEN 1.0 ELSE 0.0 END')} AS skill FROM g GROUP BY 1",
    "choice_skill": f"WITH {_GR} SELECT count(*) AS n, {r('greatest(1 - avg(2 * (p - y) * (p - y)) / nullif(1 - avg(y) * avg(y) - (1 - avg(y)) * (1 - avg(y)), 0), 0)')} AS skill FROM g",
    "tolerance_skill": f"WITH {_GR}, t AS (SELECT floor(p * 4.999) AS lvl, floor({sql_pct('fwd_return', D)} * 4.999) AS z FROM g), m AS (SELECT z FROM t GROUP BY z ORDER BY count(*) DESC, z LIMIT 1), h AS (SELECT count(*) AS n, avg(CASE WHEN abs(lvl - z) <= 1 THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN abs((SELECT z FROM m) - z) <= 1 THEN 1.0 ELSE 0.0 END) AS base FROM t) SELECT n, {r('greatest(0, CASE WHEN base < 1 THEN (hit - base) / (1 - base) WHEN hit = 1 THEN 1.0 ELSE 0.0 END)')} AS skill FROM h",
    "auc_rank": f"WITH {_GR}, t AS (SELECT up, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM g), c AS (SELECT count(*) FILTER (up) AS p, count(*) FILTER (NOT up) AS q, sum(k) FILTER (up) AS s FROM t) SELECT p AS pos, q AS neg, {r('(s - p * (p + 1) / 2) / nullif(p * q, 0)')} AS auc FROM c",
    "agreement": f"WITH {_GR} SELECT grp, count(*) AS n, {r('avg(CASE WHEN (p > 0.5) = up THEN 1.0 ELSE 0.0 END)')} AS agreement FROM g GROUP BY 1",
    "reading_stability": f"WITH {SCORED}, t AS (SELECT entity_id, abs(score - lag(score) OVER (PARTITION BY entity_id ORDER BY decision_time)) < 0.5 AS ok FROM s) SELECT entity_id, {r('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS share FROM t WHERE ok IS NOT NULL GROUP BY 1",
    "coverage": f"WITH {SCORED} SELECT {r('avg(CASE WHEN score IS NOT NULL AND fwd_return IS NOT NULL AND rt_cost IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS \"all\", " + ", ".join(f"{r(f'avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS {c}" for c in ("score", "fwd_return", "rt_cost")) + " FROM s",
    "identification": f"SELECT count(*) AS n, {r('avg(CASE WHEN (CASE WHEN contains(text, {q}revenue of{q}) THEN {q}release{q} ELSE {q}note{q} END) = doc_type THEN 1.0 ELSE 0.0 END)'.replace('{q}', chr(39)))} AS rate, {r('0.2')} AS chance FROM documents WHERE text IS NOT NULL",
    "attribution_slopes": f"WITH {_RES}, ll AS (SELECT decision_time, resid, unnest(['x1', 'x2']) AS field, unnest([x1, x2]) AS x FROM w), p AS (SELECT decision_time, field, count(*) AS n, covar_pop(x, resid) / nullif(var_pop(x), 0) AS b FROM ll WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 7), t AS (SELECT field, count(b) AS periods, avg(b) AS slope, {_TT('b')} AS t FROM p GROUP BY 1) SELECT field, periods, {r('slope')} AS slope, {r('t')} AS t, CASE WHEN coalesce(abs(t), 0) < 2 THEN 'fine' WHEN field = 'x2' THEN 'missing' WHEN t > 0 THEN 'under-weighted' ELSE 'over-weighted' END AS verdict FROM t",
    "calibration_levels": f"WITH {_RES}, p AS (SELECT decision_time, floor((x2 + 0.5) * 4.999) AS level, avg(resid) AS g FROM w WHERE resid IS NOT NULL GROUP BY 1, 2) SELECT level, count(g) AS periods, {r('avg(g)')} AS gap, {r(_TT('g'))} AS t FROM p GROUP BY 1",
    "rolling_ic_decay": f"""WITH {SCORED}, a AS (SELECT *, fwd_return - avg(fwd_return) OVER (PARTITION BY decision_time, grp) AS adj FROM s), b AS (SELECT * FROM a WHERE score IS NOT NULL AND adj IS NOT NULL), c AS (SELECT decision_time, {sql_pct('score', D)} AS x, {sql_pct('adj', D)} AS y FROM b),
        i AS (SELECT decision_time, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS ic FROM c GROUP BY 1), k AS (SELECT ic, row_number() OVER (ORDER BY decision_time DESC) AS k FROM i WHERE ic IS NOT NULL), m AS (SELECT avg(ic) FILTER (k > 12) AS early, avg(ic) FILTER (k <= 12) AS late, var_samp(ic) FILTER (k <= 12) / count(*) FILTER (k <= 12) + var_samp(ic) FILTER (k > 12) / count(*) FILTER (k > 12) AS v FROM k)
        SELECT {r('early')} AS early, {r('late')} AS late, {r('sign(early) * (late - early) / nullif(sqrt(v), 0)')} AS t FROM m""",
    "batches_by_id": f"WITH {_BA} SELECT panel_id, batch FROM f",
    "batch_pick": f"WITH {_BA} SELECT panel_id, batch FROM f WHERE k = 1",
    "grade_decisions": f"WITH {_BA}, p AS (SELECT decision_time, avg(fwd_return) FILTER (k = 1) - avg(fwd_return) AS e FROM f GROUP BY 1) SELECT count(e) AS periods, {r('avg(e)')} AS edge, {r(_TT('e'))} AS t FROM p",
    "ic_table": f"WITH {SCORED}, ll AS (SELECT decision_time, fwd_return, unnest(['score', 'rt_cost']) AS field, unnest([score, rt_cost]) AS x FROM s), m AS (SELECT * FROM ll WHERE x IS NOT NULL AND fwd_return IS NOT NULL), k AS (SELECT decision_time, field, {sql_pct('x', 'decision_time, field')} AS a, {sql_pct('fwd_return', 'decision_time, field')} AS b FROM m), i AS (SELECT decision_time, field, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS rho FROM k GROUP BY 1, 2) SELECT field, count(rho) AS periods, {r('avg(rho)')} AS ic, {r('CASE WHEN count(rho) >= 12 AND stddev_samp(rho) > 0 THEN avg(rho) / (stddev_samp(rho) / sqrt(count(rho))) END')} AS t FROM i GROUP BY 1",
    "override_split": f"""WITH {_BA}, c AS (SELECT *, fwd_return - avg(fwd_return) OVER (PARTITION BY decision_time, grp, batch) AS x, row_number() OVER (PARTITION BY decision_time, grp, batch ORDER BY rt_cost ASC NULLS LAST, panel_id) AS c FROM f),
        g AS (SELECT decision_time, grp, batch, max(CASE WHEN c = 1 THEN k END) AS m, max(CASE WHEN k = 1 THEN x END) AS model, max(CASE WHEN c = 1 THEN x END) AS pick, max(CASE WHEN c = 1 THEN abs(score) END) AS s FROM c GROUP BY 1, 2, 3),
        o AS (SELECT *, unnest(CASE WHEN s >= 1 THEN ['score', 'rt_cost'] ELSE ['rt_cost'] END) AS field FROM g WHERE m > 1 AND model IS NOT NULL AND pick IS NOT NULL),
        p AS (SELECT field, decision_time, avg(pick - model) AS v FROM o GROUP BY 1, 2), tt AS (SELECT field, avg(v) AS gain, {_TT('v')} AS t FROM p GROUP BY 1), w AS (SELECT field, count(*) AS overrides, avg(CASE WHEN pick > model THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS won FROM o GROUP BY 1)
        SELECT field, overrides, {r('gain')} AS gain, {r('t')} AS t, {r('won')} AS won FROM tt JOIN w USING (field)""",
}
