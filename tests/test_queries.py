"""Every query runs on the smallest tables, and equals its SQL in DuckDB where it has one."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import registry

LARGE = {"p2_found", "p3_found", "p4_found", "p5_found", "p6_found"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in os.listdir(data):
        p = f"{data}/{t}"
        con.sql(f"create view {t.removesuffix('.parquet')} as from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NA or v != v else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.CORE))
def test_query(spark, data, duck, name):
    got = registry.CORE[name](spark, data).toPandas()
    if name in registry.CORE_SQL:
        want = duck.sql(registry.CORE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        num = lambda t: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in t]
        assert sorted(num(rows(got)), key=repr) == sorted(num(rows(want)), key=repr)
