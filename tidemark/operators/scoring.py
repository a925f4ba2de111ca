"""One scorer for every score: rank correlation, spreads, books with costs, and one t over periods."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import exact_quantiles
from tidemark.operators.ranks import demean, pct_rank


def fill_costs(df: DataFrame, cost: str = "rt_cost") -> DataFrame:
    """Unknown costs as the exact median over all rows; NaN is unknown too."""
    if cost not in df.columns:
        raise ValueError(f"no column {cost}")
    m = exact_quantiles(df, cost, [], [0.5], "__m")
    return df.join(F.broadcast(m), how="left").withColumn(cost, F.coalesce(F.nanvl(F.col(cost).cast("double"), F.lit(None).cast("double")), F.col("__m")[0])).drop("__m")  # one row


def correlation(x: str, y: str) -> Column:
    """Pearson over the rows of a group; null instead of an error where a side doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    vx, vy = F.var_pop(F.when(both, F.col(x))), F.var_pop(F.when(both, F.col(y)))
    return F.covar_pop(x, y) / F.nullif(F.sqrt(vx * vy), F.lit(0.0))


def rank_ic(df: DataFrame, score: str = "score", ret: str = "fwd_return", period: str = "decision_time", group: str | None = "grp") -> DataFrame:
    """period, n, ic: rank correlation of the score with the group-adjusted return, over rows that have both. (A1)"""
    d = df.withColumn("__r", demean(ret, [period, group]) if group else F.col(ret)).where(F.col(score).isNotNull() & F.col("__r").isNotNull())
    d = d.select(period, pct_rank(score, [period]).alias("__a"), pct_rank("__r", [period]).alias("__b"))
    return d.groupBy(period).agg(F.count("*").alias("n"), correlation("__a", "__b").alias("ic"))


def period_t(df: DataFrame, x: str, overlap: int = 1) -> DataFrame:
    """n, mean, t over periods; t is null for fewer than 3 or without spread, and is divided by sqrt(overlap). (A10)"""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x)
    return df.agg(n.alias("n"), m.alias("mean"), F.when((n >= 3) & (s > 0), m / (F.nullif(s, F.lit(0.0)) / F.sqrt(n)) / math.sqrt(overlap)).alias("t"))


def newey_west_t(df: DataFrame, x: str, order: str, lags: int) -> DataFrame:
    """n, mean, t with Bartlett-weighted autocovariances divided by n; the periods are few."""
    one = Window.partitionBy(F.lit(0)).orderBy(order)
    d = df.where(F.col(x).isNotNull()).select(order, x)
    d = d.join(F.broadcast(d.agg(F.avg(x).alias("__m"), F.count(x).alias("__n"))))  # one row
    d = d.withColumn("__e", F.col(x) - F.col("__m"))
    d = d.select("__m", "__n", "__e", *[F.lag("__e", k).over(one).alias(f"__l{k}") for k in range(1, lags + 1)])
    var = F.sum(F.col("__e") * F.col("__e"))
    for k in range(1, lags + 1):
        var = var + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("__e") * F.col(f"__l{k}")), F.lit(0.0))
    n, m = F.first("__n"), F.first("__m")
    return d.agg(n.alias("n"), m.alias("mean"), F.when((n >= 3) & (var > 0), m / F.sqrt(var / n / n)).alias("t"))


def label_overlap(horizon_bars: int, bars_between: float) -> int:
    """Periods that one label spans, one at least."""
    return max(1, math.ceil(horizon_bars / bars_between))


def periods_per_year(schedule: str, continuous: bool) -> float:
    """(A12)"""
    days = 365 if continuous else 252
    return days / {"monthly": 30 if continuous else 21, "weekly": 7 if continuous else 5, "daily": 1}[schedule]


def mde(sd: float, n: int, bar: float, power: float = 0.8, overlap: int = 1) -> float:
    """Least mean per period that a test with this bar would find with the given power."""
    return (bar + NormalDist().inv_cdf(power)) * sd * math.sqrt(overlap) / math.sqrt(n)


def ic_noise(df: DataFrame, period: str) -> DataFrame:
    """sd: spread of a rank correlation without signal, the root mean of 1/(N-1)."""
    return df.groupBy(period).agg(F.count("*").alias("n")).where(F.col("n") > 1).agg(F.sqrt(F.avg(1 / (F.col("n") - 1))).alias("sd"))


def quantile_spreads(df: DataFrame, q: float, min_names: int, score: str = "score", ret: str = "fwd_return", period: str = "decision_time", group: str = "grp", name: str = "entity_id", cost: str = "rt_cost") -> DataFrame:
    """period, gross, cost, turnover, net of the top less the bottom q of each group, averaged over groups. (A2)

    A leg needs min_names names. Names new to a leg pay their mean cost on their share of it, against the last period
    in which the group had legs."""
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(period, group, name, ret, cost, pct_rank(score, [period, group]).alias("__p"))
    leg = F.when(F.col("__p") > 1 - q, "top").when(F.col("__p") <= q, "bottom")
    d = d.withColumn("__leg", leg).where(F.col("__leg").isNotNull())
    n_of = lambda s: F.count(F.when(F.col("__leg") == s, 1)).over(Window.partitionBy(period, group))
    d = d.withColumns({"__t": n_of("top"), "__b": n_of("bottom")}).where((F.col("__t") >= min_names) & (F.col("__b") >= min_names))
    turns = d.select(period, group).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(period)))
    d = d.join(turns, [period, group])
    was = d.select(group, "__leg", name, (F.col("__k") + 1).alias("__k"), F.lit(True).alias("__was"))
    d = d.join(was, [group, "__leg", name, "__k"], "left").withColumn("__new", F.col("__was").isNull())
    legs = d.groupBy(period, group, "__leg").agg(
        F.avg(ret).alias("r"), F.avg(F.col("__new").cast("double")).alias("share"), F.coalesce(F.avg(F.when(F.col("__new"), F.col(cost))), F.lit(0.0)).alias("c")
    )
    per = legs.groupBy(period, group).agg(
        F.sum(F.when(F.col("__leg") == "top", F.col("r")).otherwise(-F.col("r"))).alias("gross"), F.sum(F.col("share") * F.col("c")).alias("cost"), F.avg("share").alias("turnover")
    )
    out = per.groupBy(period).agg(F.avg("gross").alias("gross"), F.avg("cost").alias("cost"), F.avg("turnover").alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def rank_weighted(df: DataFrame, score: str = "score", ret: str = "fwd_return", period: str = "decision_time", group: str = "grp", name: str = "entity_id", cost: str = "rt_cost") -> DataFrame:
    """period, gross, cost, turnover, net of a book weighted by centred ranks within groups, half its gross a side. (A3)

    A change of weight costs half a round trip; names without a cost, and names that left, pay the period's median."""
    d = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(period, group, name, ret, cost, pct_rank(score, [period, group]).alias("__p"))
    d = d.withColumn("__c", F.col("__p") - F.avg("__p").over(Window.partitionBy(period, group)))
    d = d.withColumn("__w", F.coalesce(F.col("__c") / F.nullif(F.sum(F.abs("__c")).over(Window.partitionBy(period)) / 2, F.lit(0.0)), F.lit(0.0)))
    turns = d.select(period).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(period)))  # periods are few
    med = d.groupBy(period).agg(F.median(cost).alias("__med"))
    turns = turns.join(med, period)
    d = d.join(turns, period)
    now = d.select("__k", name, "__w", ret, F.coalesce(cost, "__med").alias("__cost"))
    was = d.select((F.col("__k") + 1).alias("__k"), name, F.col("__w").alias("__w0"))
    b = now.join(was, ["__k", name], "full").join(turns.select("__k", period, "__med"), "__k")
    step = F.abs(F.coalesce("__w", F.lit(0.0)) - F.coalesce("__w0", F.lit(0.0)))
    out = b.groupBy(period).agg(F.sum(F.col("__w") * F.col(ret)).alias("gross"), F.sum(0.5 * step * F.coalesce("__cost", "__med")).alias("cost"), (0.5 * F.sum(step)).alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def book_rows(df: DataFrame, score: str, ret: str, cost: str, period: str, name: str) -> DataFrame:
    """period, name, score, pct, ret, cost of the rows that have a score and a period; one without a name is ranked, but has no values."""
    d = df.where(F.col(score).isNotNull() & F.col(period).isNotNull()).select(period, name, F.col(score).alias("score"), F.col(ret).alias("ret"), F.col(cost).alias("cost"))
    d = d.repartition(F.col(period)).withColumn("pct", pct_rank("score", [period]))
    return d.select(period, name, "score", *[F.when(F.col(name).isNotNull(), F.col(c)).alias(c) for c in ("pct", "ret", "cost")])


def band_signal(enter: float, leave: float) -> Column:
    """1 above enter, 0 at or below leave or when absent, else as before. (A5)"""
    return F.when(F.col("pct") > enter, 1).when(F.col("pct").isNull() | (F.col("pct") <= leave), 0)


def top_signal(enter: float) -> Column:
    """(A6)"""
    return F.when(F.col("pct") > enter, 1).otherwise(0)


def periodic_signal(enter: float, months: list[int], period: str) -> Column:
    """Picked anew in the months listed, held until then; an absent name stays."""
    return F.when(F.month(period).isin(*months), F.when(F.coalesce(F.col("pct") > enter, F.lit(False)), 1).otherwise(0))


def _turns(g: DataFrame, signal: Column, period: str, name: str) -> DataFrame:
    """A row a period: k (its number), mean, med, and what absent names do after it: next (the first later period with a
    signal for them, and that signal) and switches (every period in which that signal becomes another)."""
    none = F.lit(None).cast("double")
    t = g.groupBy(period).agg(F.avg("ret").alias("mean"), F.median("cost").alias("med"), sum(F.count(c) for c in (name, "score", "ret", "cost")).alias("seen"))
    t = t.where(F.col("seen") >= 0)  # always so; it reads every column, so that this and the ranks read one exchange of the rows
    all_ = Window.partitionBy(F.lit(0))  # periods are few
    t = t.select(period, "mean", "med", F.row_number().over(all_.orderBy(period)).alias("k"))
    away = F.when(F.col("sig").isNotNull(), F.struct("k", "sig"))
    t = t.withColumns({"pct": none, "ret": none, "cost": none}).withColumn("sig", signal.cast("int"))
    t = t.withColumns({"next": F.last(away, True).over(all_.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)), "old": F.last("sig", True).over(all_.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))})
    return t.select(period, "k", "mean", "med", "next", F.collect_list(F.when(F.col("sig") != F.col("old"), away)).over(all_).alias("switches"))


def portfolio(g: DataFrame, signal: Column, period: str, name: str) -> DataFrame:
    """period, n, gross, cost, net, turnover, closed, closed_periods of an equal-weight book over book_rows, against the mean of all names present. (A4)

    Half a round trip is paid on a buy and on a sale, over the size of the book; a sale pays the last known cost, else
    the period's median. A held name without a return earns the universe's mean. turnover is half the trades over the size of the book;
    closed are the names sold, closed_periods how long they had been held. Periods of an empty book are left out.

    A name counts from its first period on. The signal reads pct, ret and cost, null where the name is absent, and the
    period. So all absent names have one signal a period, and a name's absence is carried as the periods in which that
    signal may change what is held, not as a row a period."""
    turns = _turns(g, signal, period, name)
    d = g.join(F.broadcast(turns.select(period, "k", "mean", "next", "switches")), period).withColumn("sig", signal.cast("int"))
    d = d.select(name, "k", "sig", F.when(F.coalesce(F.col("sig") != 0, F.lit(True)), F.col("ret") - F.col("mean")).alias("excess"), "cost", "next", "switches")
    w = Window.partitionBy(name).orderBy("k")
    upto = F.coalesce("until", F.lit(2**31 - 1))
    d = d.withColumns({"until": F.lead("k").over(w), "first": F.row_number().over(w) == 1})
    none = F.lit(None).cast("double")
    here = F.struct("k", "sig", "excess", "cost", "first")
    gone = F.when(F.col("next.k") < upto, F.concat(F.array("next"), F.filter("switches", lambda x: (x.k > F.col("next.k")) & (x.k < upto))))
    gone = F.transform(F.coalesce(gone, F.array().cast("array<struct<k:int,sig:int>>")), lambda x: F.struct(x.k.alias("k"), x.sig.alias("sig"), none.alias("excess"), none.alias("cost"), F.lit(False).alias("first")))
    d = d.select(name, F.explode(F.concat(F.array(here), gone)).alias("x")).select(name, "x.*")

    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("held", F.coalesce(F.last("sig", True).over(past), F.lit(0)))
    d = d.withColumns({"was": F.lag("held", 1, 0).over(w), "before": F.last("cost", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    bought, sold = (F.col("held") == 1) & (F.col("was") == 0), (F.col("held") == 0) & (F.col("was") == 1)
    d = d.withColumn("since", F.last(F.when(bought, F.col("k")), True).over(past))
    paid = F.when(bought, F.col("cost")).when(sold, F.col("before"))
    own = F.when(F.col("held") == 1, F.col("excess"))
    per = d.groupBy("k").agg(
        F.sum(F.col("held") - F.col("was")).alias("flow"), F.count(F.when(F.col("first"), 1)).alias("begun"), F.sum(own).alias("own"), F.count(own).alias("owns"), F.sum(paid).alias("paid"), F.count(paid).alias("pays"),
        F.count(F.when(bought | sold, 1)).alias("trades"), F.count(F.when(sold, 1)).alias("closed"), F.coalesce(F.sum(F.when(sold, F.col("k") - F.col("since"))), F.lit(0)).alias("closed_periods"),
    )
    so_far = Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # periods are few
    per = per.join(turns.select("k", period, "mean", "med"), "k").withColumns({"n": F.sum("flow").over(so_far), "names": F.sum("begun").over(so_far)}).where(F.col("n") > 0)
    zero, guess = F.lit(0.0), F.col("trades") - F.col("pays")
    # As sums over all names, absent ones too: null only if each of them gives null.
    gross = F.when(F.col("mean").isNull(), F.when(F.col("n") < F.col("names"), zero)).otherwise(F.coalesce("own", zero) + F.when(F.col("n") > F.col("owns"), F.col("mean") - F.col("mean")).otherwise(zero))
    cost = F.coalesce("paid", zero) + F.when((guess > 0) & F.col("med").isNotNull(), guess * F.col("med")).otherwise(zero)
    cost = F.when(F.col("med").isNotNull() | (guess < F.col("names")), cost)
    out = per.select(period, "n", (gross / F.col("n")).alias("gross"), (0.5 * cost / F.col("n")).alias("cost"), (0.5 * F.col("trades") / F.col("n")).alias("turnover"), "closed", "closed_periods")
    return out.select(period, "n", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"), "turnover", "closed", "closed_periods")


def book_summary(book: DataFrame, periods_per_year: float = 12.0) -> DataFrame:
    """periods, gross, mean (net), t, turnover a year, mean holding of closed positions, and share of the gross that costs take."""
    n, m, s = F.count("net"), F.avg("net"), F.stddev_samp("net")
    return book.agg(n.alias("periods"), F.avg("gross").alias("gross"), (F.lit(float(periods_per_year)) * F.avg("turnover")).alias("turnover"), (F.sum("closed_periods") / F.nullif(F.sum("closed"), F.lit(0))).alias("holding"), m.alias("mean"), F.when((n >= 3) & (s > 0), m / (F.nullif(s, F.lit(0.0)) / F.sqrt(n))).alias("t"), (F.sum("cost") / F.nullif(F.abs(F.sum("gross")), F.lit(0.0))).alias("lost"))
