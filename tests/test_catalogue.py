"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pytest

from logspark import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want
