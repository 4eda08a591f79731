"""Every SQL of the package agrees with its query on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from utterlake.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(D + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert got == want
