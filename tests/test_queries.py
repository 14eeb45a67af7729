"""Every query that has SQL gives the same rows at the smallest size, wherever the test tables are present."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("-" if pd.api.types.is_scalar(v) and pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
