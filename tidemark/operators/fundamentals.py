"""Reported fundamentals: yearly ratios, quarterly features, their instants, and trades of insiders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import in_window, nearest
from tidemark.operators.facts import ratio

#: What is read of yearly and of quarterly reports.
YEARLY = ("revenue", "gross_profit", "operating_income", "net_income", "total_assets", "total_liabilities", "cash", "rnd", "capex", "shares")
FLOWS = ("revenue", "gross_profit", "cost_of_revenue", "operating_income")
QUARTERLY = (*FLOWS, "inventory")
ANNUAL_RATIOS = ("revenue_growth", "gross_margin", "operating_margin", "net_margin", "roa", "liabilities_to_assets", "cash_to_assets", "rnd_intensity", "capex_intensity", "share_dilution")


def _wide(facts: DataFrame, keys: Sequence[str], concepts: Sequence[str], dated_by: Sequence[str]) -> DataFrame:
    """A row a period with a column a concept, and filed: the latest day on which one of dated_by was reported."""
    pick = lambda c: F.min_by("val", F.when((F.col("concept") == c) & F.col("val").isNotNull(), F.struct("filed", "val")))
    filed = F.max(F.when(F.col("concept").isin(*dated_by) & F.col("val").isNotNull(), F.col("filed"))).alias("filed")
    return facts.groupBy(*keys, "end").agg(*[pick(c).alias(c) for c in concepts], filed)


def annual_ratios(facts: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """keys, end, filed and ANNUAL_RATIOS of each yearly period.

    facts: keys, concept, end, filed, val; of values of one concept and period the first reported counts (the least, on
    one day). Growth is against the period before that was reported, however long ago. A denominator that is 0 or
    missing, or any missing part, gives null."""
    w = _wide(facts, keys, YEARLY, YEARLY)
    before = lambda c: F.lag(c).over(Window.partitionBy(*keys).orderBy("end"))
    c = F.col
    cols = {
        "revenue_growth": ratio(c("revenue") - before("revenue"), F.abs(before("revenue"))),
        "gross_margin": ratio(c("gross_profit"), c("revenue")), "operating_margin": ratio(c("operating_income"), c("revenue")),
        "net_margin": ratio(c("net_income"), c("revenue")), "roa": ratio(c("net_income"), c("total_assets")),
        "liabilities_to_assets": ratio(c("total_liabilities"), c("total_assets")), "cash_to_assets": ratio(c("cash"), c("total_assets")),
        "rnd_intensity": ratio(c("rnd"), c("revenue")), "capex_intensity": ratio(c("capex"), c("revenue")),
        "share_dilution": ratio(c("shares") - before("shares"), before("shares")),
    }
    return w.select(*keys, "end", "filed", *[cols[k].alias(k) for k in ANNUAL_RATIOS])


def quarterly_features(facts: DataFrame, keys: Sequence[str] = ("entity",), extended: bool = False) -> DataFrame:
    """keys, end, filed and the features of each quarter, dated by its flows; quarters without a dated flow are left out.

    Against the quarter that ended nearest to 364 or 91 days before, within 20 days: growth of revenue over a year and
    a quarter, changes of gross margin and inventory days. extended adds the change of yearly growth, of operating
    margin and of research intensity; research reported after the quarter's date is left out. Shares of revenue need
    revenue above 0."""
    names = [*QUARTERLY, *(["rnd"] if extended else [])]
    w = _wide(facts, keys, names, FLOWS).where(F.col("filed").isNotNull())
    if extended:
        late = facts.where((F.col("concept") == "rnd") & F.col("val").isNotNull()).groupBy(*keys, "end").agg(F.min("filed").alias("__rnd"))
        w = w.join(late, [*keys, "end"], "left").withColumn("rnd", F.when(F.col("__rnd") <= F.col("filed"), F.col("rnd"))).drop("__rnd")
    c = F.col
    over = lambda x, d: x / F.when(d > 0, d)
    w = w.withColumn("__gross", F.coalesce("gross_profit", c("revenue") - c("cost_of_revenue"))).withColumn("__cogs", F.coalesce("cost_of_revenue", c("revenue") - c("gross_profit")))
    w = w.withColumns({"q_gross_margin": over(c("__gross"), c("revenue")), "q_op_margin": over(c("operating_income"), c("revenue")), "q_inventory_days": over(c("inventory"), c("__cogs")) * 91})
    if extended:
        w = w.withColumn("q_rnd_intensity", over(c("rnd"), c("revenue")))
    kept = ["revenue", "q_gross_margin", "q_op_margin", "q_inventory_days", *(["q_rnd_intensity"] if extended else [])]

    def ago(d: DataFrame, days: int, columns: Sequence[str], out: str) -> DataFrame:
        past = d.select(*keys, "end", F.struct(*columns).alias("__row"))
        return nearest(d, past, list(keys), "end", "end", days, 20, "__row", out)

    w = ago(ago(w, 364, kept, "__year"), 91, ["revenue"], "__quarter")
    growth = lambda row: over(c("revenue"), c(f"{row}.revenue")) - 1
    w = w.withColumns({"q_rev_growth_yoy": growth("__year"), "q_rev_growth_qoq": growth("__quarter")})
    w = w.withColumns({f"{k}_chg_yoy": c(k) - c(f"__year.{k}") for k in ("q_gross_margin", "q_inventory_days", *(["q_op_margin", "q_rnd_intensity"] if extended else []))})
    cols = ["q_rev_growth_yoy", "q_rev_growth_qoq", "q_gross_margin", "q_gross_margin_chg_yoy", "q_op_margin", "q_inventory_days", "q_inventory_days_chg_yoy"]
    if extended:
        w = ago(w, 364, ["q_rev_growth_yoy"], "__growth").withColumn("q_rev_growth_yoy_chg4", c("q_rev_growth_yoy") - c("__growth.q_rev_growth_yoy"))
        cols += ["q_rev_growth_yoy_chg4", "q_op_margin_chg_yoy", "q_rnd_intensity", "q_rnd_intensity_chg_yoy"]
    return w.select(*keys, "end", "filed", *cols)


def next_midnight(day: Column, tz: str) -> Column:
    """The instant at which the day after `day` begins in tz: when what was filed on that day counts as known."""
    start = F.timestamp_micros(F.unix_date(F.date_add(day, 1)).cast("long") * F.lit(86_400_000_000))
    return F.to_utc_timestamp(start, tz)


def as_observations(features: DataFrame, keys: Sequence[str], columns: Sequence[str], tz: str) -> DataFrame:
    """keys, available_at, seq, feature, value: known from the midnight after filing.

    Of periods filed on one day the latest counts: its seq is the greatest. Missing values and undated rows give none."""
    f = features.where(F.col("filed").isNotNull()).withColumn("available_at", next_midnight(F.col("filed"), tz)).withColumn("seq", F.unix_date("end").cast("long"))
    return f.select(*keys, "available_at", "seq", *columns).unpivot([*keys, "available_at", "seq"], list(columns), "feature", "value").where(F.col("value").isNotNull())


def insider_windows(points: DataFrame, point_time: str, trades: DataFrame, trade_time: str, keys: Sequence[str], days: int, point_id: str, owner: str, buy: str, officer: str, usd: str) -> DataFrame:
    """point_id, buyers, sellers, officer_buyers, net_share over the trades of the window before each point.

    Distinct owners; net_share is bought less sold as a share of both, 0 where there was nothing."""
    b, s = F.coalesce(F.col(buy), F.lit(False)), ~F.coalesce(F.col(buy), F.lit(False))
    bought, sold = F.coalesce(F.sum(F.when(b, F.col(usd))), F.lit(0.0)), F.coalesce(F.sum(F.when(s, F.col(usd))), F.lit(0.0))
    aggs = [
        F.countDistinct(F.when(b, F.col(owner))).alias("buyers"), F.countDistinct(F.when(s, F.col(owner))).alias("sellers"), F.countDistinct(F.when(b & F.col(officer), F.col(owner))).alias("officer_buyers"),
        F.when(bought + sold > 0, (bought - sold) / F.nullif(bought + sold, F.lit(0.0))).otherwise(0.0).alias("net_share"),
    ]
    got = in_window(points, point_time, trades, trade_time, keys, days, aggs, point_id)
    return got.select(point_id, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("buyers", "sellers", "officer_buyers")], F.coalesce("net_share", F.lit(0.0)).alias("net_share"))
