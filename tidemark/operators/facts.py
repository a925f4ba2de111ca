"""Reported facts: first filings, derived quarters, ratios, event categories, names and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def durations(facts: DataFrame, start: str, end: str) -> DataFrame:
    """facts with span: year, quarter or nine_months by their length in days; others are left out."""
    n = F.datediff(end, start)
    return facts.withColumn("span", F.when(n.between(350, 380), "year").when(n.between(80, 100), "quarter").when(n.between(260, 285), "nine_months")).where(F.col("span").isNotNull())


def with_fourth_quarter(facts: DataFrame, keys: Sequence[str], end: str, filed: str, value: str) -> DataFrame:
    """The quarters, and a fourth of each year: the year less its nine months, known when both are.

    The nine months must end 80 to 100 days before the year."""
    q = facts.where("span = 'quarter'").select(*keys, end, filed, value)
    y = facts.where("span = 'year'").select(*keys, end, filed, value)
    m = facts.where("span = 'nine_months'").select(*keys, F.col(end).alias("__e"), F.col(filed).alias("__f"), F.col(value).alias("__v"))
    y = y.join(m, list(keys)).where(F.datediff(end, "__e").between(80, 100))
    y = y.select(*keys, end, F.greatest(filed, "__f").alias(filed), (F.col(value) - F.col("__v")).alias(value))
    new = y.join(q.select(*keys, end), [*keys, end], "left_anti")
    return q.unionByName(new)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0 or missing."""
    return a / F.nullif(b, F.lit(0.0))


def growth(x: str, keys: Sequence[str], order: str) -> Column:
    """Against the previous reported row."""
    was = F.lag(x).over(Window.partitionBy(*keys).orderBy(order))
    return ratio(F.col(x) - was, F.abs(was))


def categories(df: DataFrame, items: str, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """A row an item of a comma list, with its category; unknown items and those in drop are left out."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    d = df.withColumn("item", F.explode(F.split(items, ","))).withColumn("item", F.trim("item"))
    return d.withColumn("category", m[F.col("item")]).where(F.col("category").isNotNull() & ~F.col("item").isin(*drop))


def plain_name(c: Column) -> Column:
    """A name in upper case, letters and digits only, without legal forms."""
    c = F.regexp_replace(F.upper(c), r"/[A-Z]{2}/?\s*$", " ")
    c = F.regexp_replace(F.regexp_replace(c, "&", " AND "), "[^A-Z0-9 ]", " ")
    c = F.regexp_replace(c, r"\b(INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|PLC|LP|LLC|TRUST)\b", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def unique_name_map(left: DataFrame, left_name: str, left_key: str, right: DataFrame, right_name: str, right_key: str) -> DataFrame:
    """left_key, right_key of equal plain names, where a name has one key on the left."""
    l = left.select(plain_name(F.col(left_name)).alias("n"), left_key).where("n != ''")  # noqa: E741
    one = l.groupBy("n").agg(F.min(left_key).alias(left_key), F.countDistinct(left_key).alias("k")).where("k = 1").drop("k")
    r = right.select(plain_name(F.col(right_name)).alias("n"), right_key).where("n != ''")
    return one.join(r, "n").select(left_key, right_key)
