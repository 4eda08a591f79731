"""The driver's contract; every oracle agrees with its query on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(D + "/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("p") or not n[1].isdigit()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*cols).collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
