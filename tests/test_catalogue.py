"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from hirelake import catalogue_queries as c


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False, name=None):
        out.append(tuple("-" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(c.ORACLE))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert rows(c.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(c.ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(c.QUERIES) == set(c.ORACLE)
