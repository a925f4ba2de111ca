"""Grading of readings and tracking of inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import totals_before, value_cell
from tidemark.operators.ranks import pct_rank
from tidemark.operators.ridge import Grams, out_of_fold
from tidemark.operators.scoring import correlation


def brier_skill(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - BS / BS of the base rate; without spread in y 1 if perfect, else 0. (G1)"""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    bs, m = F.avg(F.pow(F.col(p) - F.col(y), 2)), F.avg(y)
    base = m - m * m
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.when(base > 1e-12, 1 - bs / F.nullif(base, F.lit(0.0))).otherwise(F.when(bs <= 1e-12, 1.0).otherwise(0.0)).alias("skill"))


def choice_skill(df: DataFrame, probs: Sequence[tuple[str, str]], y: str) -> DataFrame:
    """Multi-class Brier skill against the label frequencies, 0 at least; a missing prediction makes it 0."""
    per = sum((F.pow(F.coalesce(F.col(c), F.lit(0.0)) - (F.col(y) == k).cast("double"), 2) for k, c in probs), F.lit(0.0))
    gone = F.max(F.greatest(*[F.col(c).isNull().cast("int") for _, c in probs]))
    base = F.lit(1.0) - sum((F.pow(F.avg((F.col(y) == k).cast("double")), 2) for k, _ in probs), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.when(gone == 1, 0.0).otherwise(F.greatest(1 - F.avg(per) / F.nullif(base, F.lit(0.0)), F.lit(0.0))).alias("skill"))


def tolerance_skill(df: DataFrame, level: str, y: str, tol: float = 1.0) -> DataFrame:
    """Share within tolerance against that of the commonest label, the smallest on a tie; 0 at least."""
    mode = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("__n")).agg(F.min_by(y, F.struct(-F.col("__n"), F.col(y))).alias("__m"))
    d = df.where(F.col(y).isNotNull()).join(F.broadcast(mode))  # one row
    hit = F.avg((F.abs(F.col(level) - F.col(y)) <= tol).cast("double"))
    base = F.avg((F.abs(F.col("__m") - F.col(y)) <= tol).cast("double"))
    return d.agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.when(base < 1, (hit - base) / F.nullif(1 - base, F.lit(0.0))).otherwise(F.when(hit == 1, 1.0).otherwise(0.0))).alias("skill"))


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the curve by average ranks; null with one class."""
    d = _global_ranks(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()), score, y)
    pos, neg = F.sum(F.when(F.col(y), F.col("__n"))), F.sum(F.when(~F.col(y), F.col("__n")))
    return d.agg(pos.alias("pos"), neg.alias("neg"), ((F.sum(F.when(F.col(y), F.col("__n") * F.col("__r"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))


def _global_ranks(d: DataFrame, score: str, y: str) -> DataFrame:
    """y, __n, __r: counts by distinct score and class, with the score's average rank over the table.

    Distinct scores are counted first; their running counts are taken over cells of scores."""
    per = d.groupBy(score).agg(F.count("*").alias("__c")).withColumn("__below", F.col("__c")).withColumn("__cell", value_cell(F.col(score).cast("double")))
    per = totals_before(per, [], "__cell", score, ["__below"])
    per = per.select(score, (F.col("__below") + (F.col("__c") + 1) / 2).alias("__r"))
    return d.groupBy(score, y).agg(F.count("*").alias("__n")).join(per, score).select(y, "__n", "__r")


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(G3)"""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of rows with every field."""
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).isNotNull()
    return df.agg(F.avg(ok.cast("double")).alias("all"), *[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields])


def stable(a: Column, b: Column, kind: str) -> Column:
    """Whether two readings of one thing agree: nearer than 0.1 for a probability, than half a level for a scale."""
    return F.abs(a - b) < {"probability": 0.1, "yes_no": 0.1, "scale": 0.5}[kind]


def stable_choice(a: Column, b: Column) -> Column:
    """Whether two distributions (maps) over options agree: total variation under 0.1."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    gap = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.abs(F.coalesce(a[k], F.lit(0.0)) - F.coalesce(b[k], F.lit(0.0))))
    return 0.5 * gap < 0.1


def invariance(pairs: DataFrame, held: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, share of the answers to a text and to its probe that held still; pairs without both answers don't count."""
    return pairs.where(F.col(held).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(held).cast("double")).alias("share"))


def moved(before: Column, after: Column, up: bool, kind: str, others: Sequence[Column]) -> Column:
    """A counterfactual passes if its target moves the right way, by 0.1 or half a level, and nine tenths of the other
    answers hold; null answers fail. (G7)"""
    least = {"probability": 0.1, "yes_no": 0.1, "scale": 0.5}[kind]
    step = (after - before) * (1 if up else -1) >= least - 1e-12
    held = sum((F.coalesce(o, F.lit(False)).cast("double") for o in others), F.lit(0.0)) / len(others) if others else F.lit(1.0)
    return F.coalesce(step, F.lit(False)) & (held >= 0.9)


def identification_gate(guesses: DataFrame, probs: str, truth: str, most: float = 0.05) -> DataFrame:
    """n, accuracy, chance, excess, z, passed: whether masked names are guessed better than by chance.

    probs maps candidates to probabilities; a truth tied at the top among k has 1/k; no candidates is a miss."""
    top = F.array_max(F.map_values(probs))
    tied = F.filter(F.map_entries(probs), lambda e: e["value"] == top)
    hit = F.when(F.exists(tied, lambda e: e["key"] == F.col(truth)), 1.0 / F.size(tied)).otherwise(0.0)
    chance = 1.0 / F.greatest(F.size(F.map_keys(probs)), F.lit(1))
    d = guesses.agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(0.0))).alias("accuracy"), F.avg(chance).alias("chance"))
    d = d.withColumn("excess", F.col("accuracy") - F.col("chance"))
    se = F.sqrt(F.col("chance") * (1 - F.col("chance")) / F.greatest("n", F.lit(1)))
    return d.withColumn("z", F.when(se > 0, F.col("excess") / F.nullif(se, F.lit(0.0)))).withColumn("passed", F.col("excess") <= most)


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, pct_rank(a, by).alias("__a"), pct_rank(b, by).alias("__b"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), correlation("__a", "__b").alias("rho"))


#: Weights of the five grades, and the gains that count as full.
GRADES = {"A": 0.30, "B": 0.25, "C": 0.30, "D": 0.10, "E": 0.05}
FULL_GAIN = {"r2": 0.05, "react": 0.10, "drift": 0.05}


def summary_score(a: float, b: float, gains: Mapping[str, float], e: float, full: Mapping[str, float] | None = None) -> dict[str, float]:
    """S and its parts: C from the gains in r2 and react, D from that in drift, each a share of its full gain, 0 to 1."""
    full = full or FULL_GAIN
    part = lambda k: min(1.0, max(0.0, gains.get(k) or 0.0) / full[k])
    parts = {"A": a or 0.0, "B": b or 0.0, "C": (part("r2") + part("react")) / 2, "D": part("drift"), "E": e or 0.0}
    return {"S": sum(w * parts[k] for k, w in GRADES.items()), **parts}


def harness_score(splits: Mapping[str, dict]) -> dict[str, dict[str, float]]:
    """summary_score of each split; a split is its a, b, gains and e."""
    return {k: summary_score(**v) for k, v in splits.items()}


def paired_bootstrap(new: Mapping[str, np.ndarray], old: Mapping[str, np.ndarray], stat, rounds: int = 200, seed: int = 0) -> dict[str, float]:
    """delta, lo, hi (2.5 and 97.5 %) of stat(new) - stat(old), entities drawn with replacement, the same for both."""
    rng = np.random.default_rng(seed)
    names = sorted(set(new) & set(old))
    value = lambda v, pick: stat(np.concatenate([v[n] for n in pick]))
    gap = lambda pick: value(new, pick) - value(old, pick)
    got = [gap([names[i] for i in rng.integers(0, len(names), len(names))]) for _ in range(rounds)]
    return {"delta": float(gap(names)), "lo": float(np.quantile(got, 0.025)), "hi": float(np.quantile(got, 0.975))}


def bootstrap(values: dict[str, np.ndarray], stat, rounds: int = 1000, seed: int = 0) -> tuple[float, float]:
    """2.5 and 97.5 % of a statistic over entities drawn with replacement."""
    rng = np.random.default_rng(seed)
    names = sorted(values)
    got = [stat(np.concatenate([values[names[i]] for i in rng.integers(0, len(names), len(names))])) for _ in range(rounds)]
    return float(np.percentile(got, 2.5)), float(np.percentile(got, 97.5))


def question_efficacy(g: Grams, questions: Mapping[str, Sequence[str]], fold_of, alpha: float = 10.0, least: float = 0.002) -> list[tuple[str, float, str]]:
    """question, gain in out-of-fold R2 with against without its columns, keep or drop.

    From moment matrices alone: leaving a question out is leaving rows and columns out, without another pass."""
    folds = sorted({fold_of(t) for t in g.times})

    def r2(h: Grams) -> float:
        total, fits = h.mats.sum(0), out_of_fold(h, fold_of, alpha)
        err = 0.0
        for f in folds:
            m = sum(m for m, t in zip(h.mats, h.times) if fold_of(t) == f)
            v = np.concatenate([fits[f], [-1.0]])
            err += v @ m @ v
        return float(1 - err / (total[-1, -1] - total[0, -1] ** 2 / total[0, 0]))

    whole, out = r2(g), []
    for q, cols in questions.items():
        gain = whole - r2(g.keep([f for f in g.features if f not in set(cols)]))
        out.append((q, gain, "keep" if gain > least else "drop"))
    return out


def identification(df: DataFrame, guess: str, truth: str, ties: str, choices: int) -> DataFrame:
    """Credit 1/k for a guess tied among k, against chance."""
    return df.agg(F.count("*").alias("n"), F.avg(F.when(F.col(guess) == F.col(truth), 1 / F.col(ties)).otherwise(0.0)).alias("rate"), F.lit(1 / choices).alias("chance"))


def residual_frame(df: DataFrame, score: str, ret: str, period: str, group: str, end: str, cutoff: Column) -> DataFrame:
    """Rows of closed labels with resid: rank of the adjusted return less rank of the score. (K1)"""
    d = df.where((F.col(end) < cutoff) & F.col(score).isNotNull() & F.col(ret).isNotNull())
    d = d.withColumn("__adj", F.round(F.col(ret) - F.avg(ret).over(Window.partitionBy(period, group)), 10))  # equal values tie whatever the order of sums
    return d.withColumn("resid", pct_rank("__adj", [period]) - pct_rank(score, [period])).drop("__adj")


def attribution(df: DataFrame, inputs: Sequence[str], period: str, weights: dict[str, float]) -> DataFrame:
    """field, periods, slope, t, verdict: slopes of the residual on each input alone, a t over periods. (K2)

    A period needs five rows more than inputs. |t| of 2 or more says missing, under- or over-weighted, by the sign
    against the weight in force."""
    long = df.select(period, "resid", *inputs).unpivot([period, "resid"], list(inputs), "field", "x").where(F.col("x").isNotNull())
    per = long.groupBy(period, "field").agg(F.count("*").alias("n"), (F.covar_pop("x", "resid") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("b")).where(F.col("n") >= len(inputs) + 5)
    n, m, s = F.count("b"), F.avg("b"), F.stddev_samp("b")
    t = per.groupBy("field").agg(n.alias("periods"), m.alias("slope"), F.when((n >= 3) & (s > 0), m / (F.nullif(s, F.lit(0.0)) / F.sqrt(n))).alias("t"))
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("field")]
    verdict = F.when(F.coalesce(F.abs("t"), F.lit(0.0)) < 2, "fine").when(F.coalesce(w, F.lit(0.0)) == 0, "missing").when(F.signum("t") == F.signum(w), "under-weighted").otherwise("over-weighted")
    return t.withColumn("verdict", verdict)


def calibration(df: DataFrame, level: str, period: str) -> DataFrame:
    """level, periods, gap, t: mean residual by level and its t over periods; gaps differ from 0 where the scale bends. (K3)"""
    per = df.where(F.col(level).isNotNull() & F.col("resid").isNotNull()).groupBy(period, level).agg(F.avg("resid").alias("g"))
    n, m, s = F.count("g"), F.avg("g"), F.stddev_samp("g")
    return per.groupBy(level).agg(n.alias("periods"), m.alias("gap"), F.when((n >= 3) & (s > 0), m / (F.nullif(s, F.lit(0.0)) / F.sqrt(n))).alias("t"))


def decay(ics: DataFrame, period: str, recent: int = 24) -> DataFrame:
    """early, late, t: mean of the last periods against those before, signed by the early mean; -2 or less is decay. (K4)"""
    d = ics.where("ic is not null").withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(period).desc())))  # periods are few
    late, early = (F.when(F.col("__k") <= recent, F.col("ic")), F.when(F.col("__k") > recent, F.col("ic")))
    var = F.var_samp(late) / F.count(late) + F.var_samp(early) / F.count(early)
    return d.agg(F.avg(early).alias("early"), F.avg(late).alias("late"), (F.signum(F.avg(early)) * (F.avg(late) - F.avg(early)) / F.nullif(F.sqrt(var), F.lit(0.0))).alias("t"))


def batches(df: DataFrame, by: Sequence[str], id_: str, n: int, seed: int | None = None) -> DataFrame:
    """Rows in batches of n of one group, by a seeded hash (or by id without seed); leftovers are skipped."""
    order = [F.xxhash64(F.lit(seed), F.col(id_))] if seed is not None else []
    w = Window.partitionBy(*by).orderBy(*order, id_)
    d = df.withColumn("__rn", F.row_number().over(w)).withColumn("batch", F.floor((F.col("__rn") - 1) / n))
    return d.withColumn("__n", F.count("*").over(Window.partitionBy(*by, "batch"))).where(F.col("__n") == n).drop("__rn", "__n")


def cards(df: DataFrame, inputs: Sequence[str], top: int) -> Column:
    """A line of the inputs with the largest contributions."""
    parts = F.array(*[F.struct((-F.abs(F.col(c))).alias("k"), F.lit(c).alias("name"), F.col(c).alias("v")) for c in inputs])
    few = F.slice(F.array_sort(F.filter(parts, lambda p: p["v"].isNotNull())), 1, top)
    return F.array_join(F.transform(few, lambda p: F.format_string("%s %+.3f", p["name"], p["v"])), "; ")


def grade_picks(df: DataFrame, picked: str, ret: str, period: str) -> DataFrame:
    """Picks against the mean of their batches: period means, then t."""
    per = df.groupBy(period).agg((F.avg(F.when(F.col(picked), F.col(ret))) - F.avg(ret)).alias("edge"))
    n, m, s = F.count("edge"), F.avg("edge"), F.stddev_samp("edge")
    return per.agg(n.alias("periods"), m.alias("edge"), F.when((n >= 3) & (s > 0), m / (F.nullif(s, F.lit(0.0)) / F.sqrt(n))).alias("t"))


def override_split(decisions: DataFrame, fields: str, pick: str, model: str, period: str) -> DataFrame:
    """field, overrides, gain, t, won of the decisions that differ from the model's, by each field that led them.

    gain and t are over period means of pick less model; won is the share of overrides that did better."""
    o = decisions.withColumn("field", F.explode(fields))
    per = o.groupBy("field", period).agg(F.avg(F.col(pick) - F.col(model)).alias("v"), F.count("*").alias("c"), F.sum((F.col(pick) > F.col(model)).cast("double")).alias("w"))
    n, s = F.count("v"), F.stddev_samp("v")
    return per.groupBy("field").agg(F.sum("c").alias("overrides"), F.avg("v").alias("gain"), F.when((n >= 3) & (s > 0), F.avg("v") / (F.nullif(s, F.lit(0.0)) / F.sqrt(n))).alias("t"), (F.sum("w") / F.sum("c")).alias("won"))


def spotcheck(docs: DataFrame, id_: str, flagged: Column, plain: int = 20, marked: int = 10, seed: int = 0) -> DataFrame:
    """A fixed sample of documents to check by hand: so many plain ones and so many flagged."""
    d = docs.withColumn("flagged", F.coalesce(flagged, F.lit(False))).withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_)))
    pick = lambda f, n: d.where(F.col("flagged") == f).orderBy("__h", id_).limit(n)
    return pick(False, plain).unionByName(pick(True, marked)).drop("__h")


def with_overrides(labels: DataFrame, fixes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """labels with the checked values in place of theirs."""
    f = fixes.select(*keys, F.col(value).alias("__fix")).dropDuplicates(list(keys))
    return labels.join(f, list(keys), "left").withColumn(value, F.coalesce("__fix", value)).drop("__fix")


def reading_quality(stable_share: Column, found_share: Column, spread: Column) -> Column:
    """poor if unstable, seldom answered or hardly varying, else fine. (K5)"""
    return F.when((found_share < 0.3) | (stable_share < 0.8) | (spread < 0.15), "poor").otherwise("fine")
