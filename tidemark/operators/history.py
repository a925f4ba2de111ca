"""History of changing attributes: gaps and islands over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cells import neighbour, running_count, time_cell
from tidemark.session import table, trimmed

#: Days of snapshots in a cell; a key's rows are spread over as many tasks as it has cells.
CELL_DAYS = 512


def attribute_history(snaps: DataFrame, key: str, at: str, seq: str, attributes: dict[str, Column], days: int = CELL_DAYS) -> DataFrame:
    """key, version (from 1), opened_at, opened_by, closed_at, closed_by (null for the last), and the attributes.

    Of the rows of one key and instant only the greatest seq counts. A version opens at the key's first snapshot and
    at each that differs from the snapshot before in any attribute; a null equals a null, NaN equals NaN, -0.0 equals
    0.0, and a value that comes back opens a version again. Rows without key, instant or seq have no place in the
    order and are left out. An empty table gives an empty one.

    Plan: lag comparison of an attribute hash, confirmed on the attributes themselves, marks the changes; their running
    count numbers the islands; the next island's start closes one. All three run within cells of time, so a key that
    holds a third of all rows is no single task.
    """
    names = list(attributes)
    s = snaps.select(F.col(key).alias("__key"), F.unix_micros(at).alias("__at"), F.col(seq).alias("__seq"), *[c.alias(f"__a_{n}") for n, c in attributes.items()])
    s = s.where(F.col("__key").isNotNull() & F.col("__at").isNotNull() & F.col("__seq").isNotNull())
    s = s.groupBy("__key", "__at").agg(F.max_by(F.struct("__seq", *[f"__a_{n}" for n in names]), "__seq").alias("__row"))
    s = s.select("__key", "__at", F.col("__row.__seq").alias("__seq"), *[F.col(f"__row.__a_{n}") for n in names])
    s = s.withColumn("__cell", time_cell(F.col("__at"), days))
    s = s.withColumn("__now", F.struct(F.xxhash64(*[f"__a_{n}" for n in names]).alias("hash"), *[F.col(f"__a_{n}").alias(n) for n in names]))
    s = neighbour(s, ["__key"], "__cell", ["__at"], "__now", "__was", back=True)
    changed = F.col("__was").isNull() | (F.col("__now.hash") != F.col("__was.hash"))
    for n in names:
        changed = changed | ~F.col(f"__now.{n}").eqNullSafe(F.col(f"__was.{n}"))
    v = s.where(changed).select("__key", "__cell", "__at", F.struct(F.col("__seq").alias("seq"), F.col("__at").alias("at")).alias("__open"), F.col("__now"))
    v = neighbour(v, ["__key"], "__cell", ["__at"], "__open", "__close", back=False)
    v = running_count(v, ["__key"], "__cell", ["__at"], "version")
    return v.select(
        F.col("__key").alias(key), "version", F.timestamp_micros("__open.at").alias("opened_at"), F.col("__open.seq").alias("opened_by"),
        F.timestamp_micros("__close.at").alias("closed_at"), F.col("__close.seq").alias("closed_by"), *[F.col(f"__now.{n}").alias(n) for n in names],
    )


def size_history(snaps: DataFrame) -> DataFrame:
    return attribute_history(snaps, "cik", "_available", "snap_id", {"code": F.upper(trimmed(F.col("code"))), "mcap": F.col("mcap")})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_history(table(spark, sf_dir, "size_snapshots")).select("cik", "opened_by", F.coalesce("closed_by", F.lit(-1).cast("long")).alias("closed_by"))


QUERIES = {"p6_found": p6_found}
SQL = {
    "p6_found": """
        WITH s AS (SELECT *, upper(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS c, row_number() OVER (PARTITION BY cik, _available ORDER BY snap_id DESC) AS k
                   FROM size_snapshots WHERE cik IS NOT NULL AND _available IS NOT NULL),
        l AS (SELECT cik, _available, snap_id, c, mcap, lag(c) OVER w AS pc, lag(mcap) OVER w AS pm, row_number() OVER w AS n FROM s WHERE k = 1 WINDOW w AS (PARTITION BY cik ORDER BY _available)),
        o AS (SELECT cik, _available, snap_id FROM l WHERE n = 1 OR c IS DISTINCT FROM pc OR mcap IS DISTINCT FROM pm)
        SELECT cik, snap_id AS opened_by, coalesce(lead(snap_id) OVER (PARTITION BY cik ORDER BY _available), -1) AS closed_by FROM o"""
}
