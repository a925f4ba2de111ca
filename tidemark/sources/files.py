"""Sources and sinks: contracts, CSV markets, signals and documents, bulk TSVs, symbol lists, cached bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import page_text
from tidemark.operators.facts import first_row
from tidemark.operators.labels import validate, with_ended
from tidemark.sources.stamps import to_instants

OBSERVATION = "entity_id string, available_at timestamp, source string, feature string, value double, seq long"
DOCUMENT = "entity_id string, available_at timestamp, doc_type string, doc_id string, text string, metadata map<string,string>"


class Source(Protocol):
    """Numbers: fetch is the only step that may use a network; observations holds all that is known before `end`."""

    name: str

    def fetch(self) -> None: ...

    def observations(self, end: datetime) -> DataFrame: ...


class DocumentSource(Protocol):
    """(S2)"""

    def documents(self, end: datetime) -> DataFrame: ...


class Market(Protocol):
    """(L19)"""

    def universe(self, schedule: DataFrame) -> DataFrame: ...

    def labels(self, decisions: DataFrame) -> DataFrame: ...


def empty_observations(spark: SparkSession) -> DataFrame:
    """(S22)"""
    return spark.createDataFrame([], OBSERVATION)


class FrameDocuments:
    """Documents in memory: validated once, strictly before `end`. (S3)"""

    def __init__(self, df: DataFrame):
        self.df = validate(df, ["entity_id", "available_at", "doc_type", "doc_id", "text"], "available_at", ["doc_id", "entity_id"]).withColumn("text", F.coalesce("text", F.lit("")))

    def documents(self, end: datetime) -> DataFrame:
        return self.df.where(F.col("available_at") < F.lit(end))


def read_text_csv(spark: SparkSession, path: str, columns: Mapping[str, str], sep: str = ",") -> DataFrame:
    """A CSV with a fixed schema by header name; all cells are text and only the empty cell is missing.

    seq is the place of a row in its file, kept for ties."""
    raw = spark.read.option("sep", sep).option("multiLine", True).option("nullValue", "").csv(path, header=True, inferSchema=False)
    have = {c.lower(): c for c in raw.columns}
    alias = {"entity_id": "entity", "entity": "entity_id"}
    out = []
    for name, kind in columns.items():
        got = have.get(name) or have.get(alias.get(name, ""))
        if got is None:
            raise ValueError(f"{path}: no column {name}")
        c = F.nullif(F.col(f"`{got}`"), F.lit(""))
        out.append((c if kind == "string" else c.try_cast(kind)).alias(name))
    return raw.select(*out).withColumn("seq", F.monotonically_increasing_id())


def csv_bars(spark: SparkSession, path: str, ended_after_days: int = 10, close: str = "23:59") -> DataFrame:
    """entity_id, date, close_at, price, volume, ended."""
    b = read_text_csv(spark, path, {"entity_id": "string", "date": "date", "close": "double", "volume": "double"})
    h, m = map(int, close.split(":"))
    at = F.timestamp_micros(F.unix_date("date").cast("long") * 86_400_000_000 + (h * 60 + m) * 60_000_000)
    b = b.where(F.col("date").isNotNull()).select("entity_id", "date", at.alias("close_at"), F.col("close").alias("price"), "volume")
    return with_ended(b, "entity_id", "close_at", ended_after_days)


def csv_signals(spark: SparkSession, path: str, tz: str, source: str) -> DataFrame:
    """Observations of a CSV; unreadable values are missing, an unreadable time is an error."""
    s = read_text_csv(spark, path, {"entity_id": "string", "available_at": "string", "feature": "string", "value": "double"}).withColumn("calendar_id", F.lit(1))
    cal = spark.createDataFrame([(1, tz)], "calendar_id int, tz string")
    s = to_instants(s, "available_at", cal)
    bad = s.where(F.col("utc_micros").isNull()).limit(3).collect()
    if bad:
        raise ValueError(f"unreadable times: {[r.available_at for r in bad]}")
    return s.select("entity_id", F.timestamp_micros("utc_micros").alias("available_at"), F.lit(source).alias("source"), "feature", F.when(~F.isnan("value"), F.col("value")).alias("value"), "seq")


def csv_documents(spark: SparkSession, path: str, tz: str) -> DataFrame:
    """(S6) doc_id is entity and place in the file."""
    s = read_text_csv(spark, path, {"entity_id": "string", "available_at": "string", "doc_type": "string", "text": "string"}).withColumn("calendar_id", F.lit(1))
    s = to_instants(s, "available_at", spark.createDataFrame([(1, tz)], "calendar_id int, tz string"))
    return s.select("entity_id", F.timestamp_micros("utc_micros").alias("available_at"), "doc_type", F.concat_ws("|", "entity_id", F.col("seq").cast("string")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))


def bulk_trades(trans: DataFrame, owners: DataFrame, filings: DataFrame) -> DataFrame:
    """Insider purchases and sales of forms 4 and 4/A, one owner a filing; usd = shares * price."""
    one = first_row(owners, ["accession"], [F.col("owner")])
    t = trans.where(F.col("code").isin("P", "S")).join(filings.where(F.col("form").isin("4", "4/A")), "accession").join(one, "accession")
    return t.withColumn("usd", F.col("shares") * F.col("price")).dropDuplicates()


def common_symbols(listed: DataFrame, delisted: DataFrame, code: str) -> DataFrame:
    """Common stock: no five-letter warrants, units or rights, no suffixed classes."""
    both = listed.select(code).unionByName(delisted.select(code)).where(F.col(code).isNotNull()).distinct()
    return both.where(~F.col(code).rlike("^[A-Z]{4}[WUR]$") & ~F.col(code).rlike("[-.+=^]") & F.col(code).rlike("^[A-Z]"))


def vendor_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of a folder of gzipped CSVs, one a code; close alone stands for all prices where the file has no others."""
    raw = spark.read.option("nullValue", "").csv(f"{folder}/*.csv.gz", header=True, inferSchema=False)
    price = lambda c: (F.col(c) if c in raw.columns else F.col("close")).try_cast("double").alias(c)
    code = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv\.gz$", 1)
    return raw.select(code.alias("code"), F.col("date").try_cast("date").alias("date"), *[price(c) for c in ("open", "high", "low", "close")], F.col("volume").try_cast("double").alias("volume"))


def filing_documents(manifest: DataFrame, pages: DataFrame, codes: DataFrame, stamp: Column) -> DataFrame:
    """A document a release and code, once an accession, stamped by `stamp`."""
    once = first_row(manifest, ["accession"], [F.col("filed"), F.col("accession")])
    d = once.join(pages.select("accession", page_text(F.col("html")).alias("text")), "accession").join(codes, "cik")
    return d.select(F.col("code").alias("entity_id"), stamp.alias("available_at"), F.lit("release").alias("doc_type"), F.col("accession").alias("doc_id"), "text")


def json_facts(spark: SparkSession, path: str) -> DataFrame:
    """cik, concept, unit, start, end, filed, form, val of cached company-fact files."""
    fact = "array<struct<start:date,end:date,filed:date,form:string,val:double>>"
    kind = f"cik long, facts map<string,map<string,struct<units:map<string,{fact}>>>>"
    raw = spark.read.schema(kind).option("multiLine", True).json(path)
    c = raw.select("cik", F.explode("facts").alias("space", "concepts")).select("cik", F.explode("concepts").alias("concept", "body"))
    u = c.select("cik", "concept", F.explode("body.units").alias("unit", "rows"))
    return u.select("cik", "concept", "unit", F.explode("rows").alias("r")).select("cik", "concept", "unit", "r.*")


def size_source(lists: DataFrame, code: str, available: str, mcap: str, seq: str) -> DataFrame:
    """Log market value, usable from the list's availability."""
    good = (F.col(mcap) > 0) & (F.col(mcap) < float("inf"))
    return lists.where(F.col(code).isNotNull() & F.col(available).isNotNull()).select(F.col(code).alias("entity_id"), F.col(available).alias("available_at"), F.lit("universe").alias("source"), F.lit("size_log").alias("feature"), F.when(good, F.ln(F.when(good, F.col(mcap)))).alias("value"), F.col(seq).alias("seq"))


def write_tables(folder: str, tables: Mapping[str, DataFrame], kind: str = "parquet", options: Sequence[tuple[str, str]] = ()) -> None:
    """(S19)"""
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(kind)
        for k, v in (*options, *([("header", "true")] if kind == "csv" else [])):
            w = w.option(k, v)
        w.save(f"{folder}/{name}")
