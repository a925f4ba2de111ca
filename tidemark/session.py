"""Session defaults, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset, a temporary one of a local session (tests).

    On a cluster each executor would write to a disk of its own, so an unset folder is an error there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once; later reads survive the loss of any executor.

    With spark.cleaner.referenceTracking.cleanCheckpoints the files go when the driver has dropped the table."""
    shared_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names that no column of df has (case-insensitively), one for each base."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, k = f"__{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"__{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column, computed once a row: unlike withColumn it isn't copied into each later use or filter."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body reads it; for use where held can't be."""
    return F.transform(F.array(value), body)[0]


def number(c: Column) -> Column:
    """NaN counts as missing, -0.0 equals 0.0."""
    return F.when(~F.isnan(c), c + F.lit(0.0))


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def local_micros(ts: Column, tz: str | Column) -> Column:
    """Wall-clock microseconds of an instant in tz, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(ts, tz))


def local_date(ts: Column, tz: str | Column) -> Column:
    """Calendar date of an instant in tz, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(local_micros(ts, tz) / F.lit(86_400_000_000)).cast("int"))
