"""Queries of this part that SQL expresses, against it on the smallest tables."""

import os

import duckdb
import pytest

from claimweave.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    frame = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == sorted(found.fetchall(), key=repr)
