"""Every query against its SQL on the smallest tables, and those without SQL by what must hold."""

import os

import duckdb
import pandas as pd
import pytest

from shapelake.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else (float(v) if isinstance(v, float) else str(v)) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    for a, b in zip(rows(got), rows(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(float(y), abs=2e-6) if isinstance(x, float) else y)
