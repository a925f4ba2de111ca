"""Windows over keys of any size: rows are cut into cells of bounded length and only one row a cell is carried on.

A window over a whole key puts that key's rows into one task. Here a window runs within (key, cell); what crosses a
cell's edge comes from a table with one row a cell, whose window is as long as the number of cells, not of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def time_cell(micros: Column, days: int) -> Column:
    """Number of the cell of `days` days that holds an instant."""
    return F.floor(micros / F.lit(days * DAY)).cast("long")


def neighbour(df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[str], value: str, out: str, back: bool) -> DataFrame:
    """df with column `out`: `value` (a struct) of the row before (back) or after it in its key, null at the ends.

    Order within a key: cell, then the order columns, which must be total within a cell. Keys and cell are not null.
    """
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    near = (F.lag if back else F.lead)(value).over(w)
    edge = (F.max_by if back else F.min_by)(F.col(value), F.struct(*order))
    edges = df.groupBy(*keys, cell).agg(edge.alias("__edge"))
    over = Window.partitionBy(*keys).orderBy(cell)
    edges = edges.select(*keys, cell, (F.lag if back else F.lead)("__edge").over(over).alias("__edge"))
    return df.withColumn(out, near).join(edges, [*keys, cell], "left").withColumn(out, F.coalesce(out, "__edge")).drop("__edge")


def running_count(df: DataFrame, keys: Sequence[str], cell: str, order: Sequence[str], out: str) -> DataFrame:
    """df with column `out`: the row's number within its key from 1, in the order of `neighbour`."""
    w = Window.partitionBy(*keys, cell).orderBy(*order)
    sums = df.groupBy(*keys, cell).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, cell, F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__n"))
    return df.withColumn(out, F.row_number().over(w)).join(sums, [*keys, cell], "left").withColumn(out, F.col(out) + F.col("__n")).drop("__n")


def value_cell(x: Column) -> Column:
    """Number of the cell that holds a number: never falls as x rises, steps of 0.8 % of its size, 200,000 at most."""
    return F.floor(F.signum(x) * F.least(F.log1p(F.abs(x) * F.lit(1e6)), F.lit(800.0)) * F.lit(128.0)).cast("long")


def equal_keys(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    """Null-safe equality of keys of two aliased tables."""
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def carried(rows: DataFrame, keys: Sequence[str], cell: str, last: Sequence[Column], names: Sequence[str], forward: bool = False) -> DataFrame:
    """keys, cell and names: of each cell the latest non-null values of `last` (aggregates of a cell) in cells before it.

    One row a cell, so the window over a key is as long as its cells. With forward, the nearest in cells after it."""
    per = rows.groupBy(*keys, cell).agg(*[c.alias(n) for c, n in zip(last, names)])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(cell).desc() if forward else F.col(cell)).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, cell, *[F.last(n, True).over(w).alias(n) for n in names])


def totals_before(rows: DataFrame, keys: Sequence[str], cell: str, order: str, sums: Sequence[str]) -> DataFrame:
    """rows with each of sums replaced by its total over the rows before in its key; order is total within a key.

    Rows are cut into cells; the totals of whole cells come from a table with one row a cell."""
    over = list(keys)
    inner = Window.partitionBy(*over, cell).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*over, cell).agg(*[F.sum(s).alias(f"__b_{s}") for s in sums])
    w = Window.partitionBy(*(over or [F.lit(0)])).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*over, cell, *[F.coalesce(F.sum(f"__b_{s}").over(w), F.lit(0)).alias(f"__b_{s}") for s in sums]).alias("__p")
    near = rows.withColumns({f"__i_{s}": F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).drop(*sums).alias("__r")
    got = near.join(per, equal_keys("__r", "__p", [*over, cell]))
    keep = [c for c in rows.columns if c not in sums]
    return got.select(*[F.col(f"__r.{c}") for c in keep], *[(F.col(f"__r.__i_{s}") + F.col(f"__p.__b_{s}")).alias(s) for s in sums])


def exact_quantiles(df: DataFrame, x: str, by: Sequence[str], shares: Sequence[float], out: str) -> DataFrame:
    """by, out: array of the exact quantiles of x by linear interpolation; nulls and NaN don't count, groups of none have no row.

    Counts by distinct value and running counts over cells of values: no group's values meet in one task."""
    v = df.select(*by, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    v = v.groupBy(*by, "__x").agg(F.count("*").alias("__n")).withColumn("__before", F.col("__n")).withColumn("__cell", value_cell(F.col("__x")))
    v = totals_before(v, by, "__cell", "__x", ["__before"])
    size = v.groupBy(*by).agg(F.max(F.col("__before") + F.col("__n")).alias("__size")).alias("__s")
    at = v.alias("__v").join(size, equal_keys("__v", "__s", by)).select(*[F.col(f"__v.{k}") for k in by], "__x", "__before", "__n", "__size") if by else v.join(F.broadcast(size))  # one row
    here = lambda k: F.max(F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), F.col("__x")))
    place = [(F.col("__size") - 1) * F.lit(float(p)) for p in shares]
    ends = [here(f(q)) for q in place for f in (F.floor, F.ceil)]
    part = [F.max(q - F.floor(q)) for q in place]
    g = at.groupBy(*by).agg(*[c.alias(f"__e{i}") for i, c in enumerate(ends)], *[c.alias(f"__f{i}") for i, c in enumerate(part)])
    q = [F.col(f"__e{2 * i}") + (F.col(f"__e{2 * i + 1}") - F.col(f"__e{2 * i}")) * F.col(f"__f{i}") for i in range(len(shares))]
    return g.select(*by, F.array(*q).alias(out)).where(F.col(out)[0].isNotNull())
