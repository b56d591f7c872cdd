"""Every registered query of the workspace against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    out = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in out.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_filters_reach_the_scan(spark):
    """Equality filters are pushed into Parquet and only needed columns are read."""
    from quillspark.operators import search
    from quillspark.plans.bindings import workspace

    ws = workspace(spark, str(SF))
    plan = search.equals(ws.documents, system="en", document_type="src1").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "EqualTo(source,src1)" in plan and "text" not in plan.split("ReadSchema")[1]
