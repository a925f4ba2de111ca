"""Trailing windows over entity histories: lags, means of what came before, change points, shrunk base rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import DAY, time_cell, totals_before

#: Days of a cell of time.
CELL_DAYS = 32


def prior_mean(x: str, by: Sequence[str], order: Sequence[str], k: int, least: int) -> Column:
    """Mean of the k rows before, if at least `least` of them have a value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-k, -1)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def rolling_median(x: str, by: Sequence[str], order: Sequence[str], k: int) -> Column:
    """Median of the last k values, this one included; nulls don't count."""
    v = F.array_sort(F.collect_list(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - k, 0)))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2)


def price_features(bars: DataFrame, entity: str, order: str, price: str, volume: str, month: int = 1, year: int = 12, vol: int = 6) -> DataFrame:
    """bars with mom_1, mom_12_1, vol, from_high, volume_ratio over trailing bars; null until a year of bars is there."""
    w = Window.partitionBy(entity).orderBy(order)
    over = lambda n: w.rowsBetween(1 - n, 0)
    b = bars.withColumn("__r", F.col(price) / F.lag(price).over(w) - 1)
    full = F.row_number().over(w) > year
    dv = F.col(price) * F.col(volume)
    return b.select(
        *bars.columns,
        F.when(full, F.col(price) / F.lag(price, month).over(w) - 1).alias("mom_1"),
        F.when(full, F.lag(price, month).over(w) / F.lag(price, year).over(w) - 1).alias("mom_12_1"),
        F.when(full, F.stddev_samp("__r").over(over(vol))).alias("vol"),
        F.when(full, F.col(price) / F.max(price).over(over(year)) - 1).alias("from_high"),
        F.when(full, F.avg(dv).over(over(month * 3)) / F.nullif(F.avg(dv).over(over(vol)), F.lit(0.0))).alias("volume_ratio"),
    )


def change_points(events: DataFrame, keys: Sequence[str], at: str, weight: Column, days: int) -> DataFrame:
    """keys, at, n, total: state of the trailing window just after each entry and expiry, as observations.

    Additive totals by +1 at an event and -1 when it leaves, summed over instants first and then along the key."""
    e = events.where(F.col(at).isNotNull()).select(*keys, F.unix_micros(at).alias("__t"), F.coalesce(weight, F.lit(0.0)).alias("__w"))
    steps = e.select(*keys, F.explode(F.array(F.struct(F.col("__t").alias("t"), F.lit(1).alias("n"), F.col("__w").alias("w")), F.struct((F.col("__t") + days * DAY).alias("t"), F.lit(-1).alias("n"), (-F.col("__w")).alias("w")))).alias("s"))
    at_once = steps.groupBy(*keys, F.col("s.t").alias("at")).agg(F.sum("s.n").alias("n"), F.sum("s.w").alias("total"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return at_once.select(*keys, "at", F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total"))


def trailing(df: DataFrame, key: str, at: str, span: int, x: str, kind: str) -> DataFrame:
    """df with n, total, gross, kinds: rows of the key in the span of ticks before each row, this instant not included; the
    sums of their x and of its size, 0 without any; and how many kinds they have. Null keys are one key; at is not null. (R9)

    Time is cut into cells as long as the span, so a row's span is the end of one cell and the beginning of the next.
    A row stands in its own cell and, a span later, in the next one; there both parts are running totals, nothing is
    subtracted, and a key of any size is as many tasks as it has cells."""
    start = F.col(at) - F.pmod(F.col(at), F.lit(span))
    places = [F.struct(start.alias("cell"), F.col(at).alias("pos"), F.lit(True).alias("own")), F.struct((start + span).alias("cell"), (F.col(at) + span).alias("pos"), F.lit(False).alias("own"))]
    d = df.select("*", F.explode(F.array(*places)).alias("__p"))
    rest = [F.when(F.col("__p.own"), F.col(c)).alias(c) for c in df.columns if c not in (key, x, kind)]
    d = d.select(key, x, kind, *rest, F.col("__p.cell").alias("__cell"), F.col("__p.pos").alias("__pos"), F.col("__p.own").alias("__own"))
    w = Window.partitionBy(key, "__cell")
    begin = w.orderBy("__pos").rangeBetween(Window.unboundedPreceding, -1)
    end = w.orderBy(F.col("__pos").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own, old = F.col("__own"), ~F.col("__own")
    sums = {"n": F.lit(1), "total": F.col(x), "gross": F.abs(x)}
    part = lambda rows, over, i: {f"__{k}{i}": F.sum(F.when(rows, c)).over(over) for k, c in sums.items()} | {f"__kinds{i}": F.collect_set(F.when(rows, F.col(kind))).over(over)}
    d = d.withColumns(part(own, begin, 0)).withColumns(part(old, end, 1)).where(own)
    both = [(F.coalesce(f"__{k}0", F.lit(0)) + F.coalesce(f"__{k}1", F.lit(0))).alias(k) for k in sums]
    return d.select(*df.columns, *both, F.size(F.array_union("__kinds0", "__kinds1")).alias("kinds"))


def _so_far(d: DataFrame, keys: Sequence[str], lag: int, i: int) -> DataFrame:
    """d with __n<i>, __s<i>: number and sum of the __x with the same keys whose __t, lag later, is still earlier.

    Instants are added up first; their running totals are taken over cells of time, whatever the key holds."""
    n, s = f"__n{i}", f"__s{i}"
    ok = F.col("__t").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    x = F.col("__x")
    adds = d.where(ok).select(*keys, (F.col("__t") + lag).alias("__at"), x.isNotNull().cast("long").alias(n), F.coalesce(x, F.lit(0.0)).alias(s), F.lit(False).alias("__asks"))
    asks = d.where(ok).select(*keys, F.col("__t").alias("__at"), F.lit(0).cast("long").alias(n), F.lit(0.0).alias(s), F.lit(True).alias("__asks"))
    line = (adds.unionByName(asks) if lag else adds.withColumn("__asks", F.lit(True))).groupBy(*keys, "__at").agg(F.sum(n).alias(n), F.sum(s).alias(s), F.max("__asks").alias("__asks"))
    line = totals_before(line.withColumn("__cell", time_cell(F.col("__at"), CELL_DAYS)), keys, "__cell", "__at", [n, s]).where("__asks")
    line = line.select(*keys, F.col("__at").alias("__t"), n, s)
    return d.join(line, [*keys, "__t"], "left").withColumns({n: F.coalesce(n, F.lit(0)), s: F.coalesce(s, F.lit(0.0))})


def shrunk_means(df: DataFrame, x: str, at: str, levels: Sequence[Sequence[str]], strength: float, lag_days: float = 0, out: str = "mean", prior: float = 0.0, truth: Column | None = None) -> DataFrame:
    """df with `out`: mean of strictly earlier x (known lag_days later), shrunk from level to finer level.

    mean_L = (sum + k * parent) / (n + k); the first parent is `prior`; null while no level has data. A tie block reads
    before it adds. A level whose key is null or blank has nothing and adds nothing. truth replaces x, for hit rates."""
    value = F.col(x) if truth is None else truth
    d = df.withColumn("__t", F.unix_micros(at)).withColumn("__x", value.cast("double"))
    for i, keys in enumerate(levels):
        d = _so_far(d, list(keys), int(lag_days * DAY), i)
    mean, seen = F.lit(float(prior)), F.lit(0)
    for i in range(len(levels)):
        n, s = F.col(f"__n{i}"), F.col(f"__s{i}")
        mean = F.when(n > 0, (s + strength * mean) / (n + strength)).otherwise(mean)
        seen = seen + n
    return d.select(*df.columns, F.when(seen > 0, mean).alias(out)) if out not in df.columns else d.withColumn(out, F.when(seen > 0, mean)).select(*df.columns)


def surprise(df: DataFrame, x: str, at: str, levels: Sequence[Sequence[str]], strength: float) -> DataFrame:
    """df with surprise: x less its shrunk mean so far."""
    return shrunk_means(df, x, at, levels, strength, out="__m").withColumn("surprise", F.col(x) - F.col("__m")).drop("__m")


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows of a short table in order."""
    return df.orderBy(F.col(order).desc()).limit(n)
