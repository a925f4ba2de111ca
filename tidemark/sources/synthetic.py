"""A market with planted effects, made from hash-seeded streams: the same rows for a seed on any cluster."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """In (0, 1), a fixed function of the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(seed: int, *keys) -> Column:
    """Box-Muller of two streams."""
    return F.sqrt(-2 * F.ln(uniform(seed, F.lit("a"), *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed, F.lit("b"), *keys))


@dataclass(frozen=True)
class SyntheticMarket:
    """(S8-S10) A planted number moves the next month's return; noise numbers don't; texts tell a guidance that does."""

    entities: int = 120
    groups: int = 4
    start: date = date(2010, 1, 1)
    end: date = date(2012, 12, 31)
    daily_sd: float = 0.02
    planted: float = 0.03
    text_effect: float = 0.02
    noise: int = 3
    leak: bool = False
    seed: int = 7

    def days(self, spark: SparkSession) -> DataFrame:
        d = spark.sql(f"select explode(sequence(date'{self.start}', date'{self.end}')) day").where(F.dayofweek("day").between(2, 6))
        month = F.trunc("day", "month")
        return d.select("day", month.alias("month"), F.timestamp_micros(F.unix_date("day").cast("long") * 86_400_000_000 + 21 * 3_600_000_000).alias("close_at"))

    def names(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.entities).select(F.format_string("E%04d", "id").alias("entity_id"), F.format_string("g%d", F.pmod("id", F.lit(self.groups))).alias("grp"))

    def latents(self, spark: SparkSession) -> DataFrame:
        """entity_id, month, planted, guidance: known at the month's last close, at work in the next month."""
        m = self.days(spark).select("month").distinct()
        g = self.names(spark).crossJoin(F.broadcast(m))  # the grid itself is the data
        return g.select("entity_id", "grp", "month", normal(self.seed, F.lit("x"), "entity_id", "month").alias("planted"), F.floor(uniform(self.seed, F.lit("g"), "entity_id", "month") * 3).cast("int").alias("guidance"))

    def bars(self, spark: SparkSession) -> DataFrame:
        lat = self.latents(spark).select("entity_id", F.add_months("month", 1).alias("month"), (self.planted * F.col("planted") + self.text_effect * (F.col("guidance") - 1)).alias("push"))
        g = self.names(spark).crossJoin(F.broadcast(self.days(spark)))  # the grid itself is the data
        g = g.join(lat, ["entity_id", "month"], "left")
        r = F.coalesce(F.col("push") / 21, F.lit(0.0)) + self.daily_sd * normal(self.seed, F.lit("r"), "entity_id", "day")
        w = Window.partitionBy("entity_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        return g.select("entity_id", "grp", "day", "close_at", F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.5)))).over(w)).alias("x")).withColumn("price", 100 * F.col("x")).drop("x")

    def _stamps(self, spark: SparkSession) -> DataFrame:
        return self.days(spark).groupBy("month").agg(F.max("close_at").alias("available_at"))

    def observations(self, spark: SparkSession) -> DataFrame:
        lat = self.latents(spark).join(F.broadcast(self._stamps(spark)), "month")  # a row a month
        cols = {"planted": F.col("planted"), **{f"noise_{k}": normal(self.seed, F.lit(f"n{k}"), "entity_id", "month") for k in range(1, self.noise + 1)}}
        wide = lat.select("entity_id", "available_at", *[c.alias(k) for k, c in cols.items()])
        long = wide.unpivot(["entity_id", "available_at"], list(cols), "feature", "value")
        return long.select("entity_id", "available_at", F.lit("synthetic").alias("source"), "feature", "value", F.xxhash64("entity_id", "available_at", "feature").alias("seq"))

    TEMPLATES = (
        ("Management lowered its outlook for the year.", "The outlook was lowered after a weak quarter."),
        ("Management kept its outlook unchanged.", "The outlook was maintained."),
        ("Management raised its outlook for the year.", "The outlook was raised on higher orders."),
    )

    def documents(self, spark: SparkSession, paraphrase: int = 0) -> DataFrame:
        lat = self.latents(spark).join(F.broadcast(self._stamps(spark)), "month")  # a row a month
        pick = F.floor(uniform(self.seed + paraphrase, F.lit("t"), "entity_id", "month") * 2).cast("int")
        table = F.array(*[F.array(*[F.lit(x) for x in t]) for t in self.TEMPLATES])
        return lat.select("entity_id", "available_at", F.lit("release").alias("doc_type"), F.concat_ws("-", "entity_id", F.col("month").cast("string")).alias("doc_id"), F.concat(F.lit("COMPANY reported results. "), table[F.col("guidance")][pick]).alias("text"), F.col("guidance"))

    def gold(self, spark: SparkSession) -> DataFrame:
        """doc_id, entity_id, outlook: the true answer of each document."""
        label = F.array(F.lit("lowered"), F.lit("kept"), F.lit("raised"))[F.col("guidance")]
        return self.documents(spark).select("doc_id", "entity_id", label.alias("outlook"))

    def probes(self, spark: SparkSession) -> DataFrame:
        """doc_id, probe, text, probe_text: each document reworded, in another order, under another mask, and with the opposite guidance."""
        d = self.documents(spark).select("doc_id", "text", "guidance")
        other = self.documents(spark, paraphrase=1).select("doc_id", F.col("text").alias("p"))
        parts = F.split("text", r"(?<=\.) ")
        opposite = F.array(*[F.lit(self.TEMPLATES[2 - g][0]) for g in range(3)])[F.col("guidance")]
        kinds = {
            "paraphrase": F.col("p"),
            "order": F.array_join(F.reverse(parts), " "),
            "mask_alt": F.replace(F.col("text"), F.lit("COMPANY"), F.lit("THE FIRM")),
            "counterfactual": F.concat_ws(" ", parts[0], opposite),
        }
        probes = F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), c.alias("probe_text")) for k, c in kinds.items()])).alias("x")
        return d.join(other, "doc_id").select("doc_id", "text", "guidance", probes).select("doc_id", "text", "guidance", "x.*")

    def market_set(self, spark: SparkSession, react: int = 3, sigma: int = 60, drift: int = 20) -> DataFrame:
        """doc_id, entity_id, year, react, z, drift: of each document the market-adjusted return of the bars after it, in units
        of the entity's usual move before it, and of the bars after those; only where all bars are there. (G15)"""
        w = Window.partitionBy("entity_id").orderBy("day")
        b = self.bars(spark).withColumn("r", F.col("price") / F.lag("price").over(w) - 1)
        b = b.withColumn("a", F.col("r") - F.avg("r").over(Window.partitionBy("day")))
        over = lambda i, j: w.rowsBetween(i, j)
        b = b.withColumns({
            "react": F.sum("a").over(over(1, react)), "sd": F.stddev_samp("a").over(over(1 - sigma, 0)), "before": F.count("a").over(over(1 - sigma, 0)),
            "drift": F.sum("a").over(over(react + 1, react + drift)), "after": F.count("a").over(over(1, react + drift)),
        })
        d = self.documents(spark).select("doc_id", "entity_id", "available_at")
        ok = (F.col("before") == sigma) & (F.col("after") == react + drift) & (F.col("sd") > 0)
        b = b.where(ok).select("entity_id", F.col("close_at").alias("available_at"), "react", (F.col("react") / (F.col("sd") * float(react) ** 0.5)).alias("z"), "drift")
        return d.join(b, ["entity_id", "available_at"]).select("doc_id", "entity_id", F.year("available_at").alias("year"), "react", "z", "drift")
