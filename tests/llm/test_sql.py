"""The queries that SQL can express, against DuckDB on the smallest tables where those are there."""

import os

import duckdb
import pytest

from tallyglass.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    queries.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    want = con.sql(queries.oracle_sql()[name])
    columns = ", ".join(f'"{c}"' for c in want.columns)
    got = con.sql(f"select {columns} from '{tmp_path}/out/*.parquet'").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))
