from pathlib import Path

import duckdb
import pytest

from quillspark.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = queries.QUERIES[name](spark, str(SF))
    out = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in out.fetchall()]
    assert sorted(map(tuple, df.collect())) == sorted(want)
