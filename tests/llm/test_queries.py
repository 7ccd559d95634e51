"""Queries that have SQL, and the pipeline, on the driver's smallest tables."""

import os

import duckdb
import pytest

from logspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    sql = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    want = sorted(map(repr, sql.fetchall()))
    got = sorted(repr(tuple(r[c] for c in names)) for r in queries.queries()[name](spark, SF).collect())
    assert got == want


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0 < len(out) < len(docs) and all(r.round_trip for r in out)
    assert len({r.doc_id for r in out}) == len(out)
