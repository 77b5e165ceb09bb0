"""Queries that SQL can tell, against DuckDB."""

import os

import pytest

from codeweft.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in df.collect()) == want and want
