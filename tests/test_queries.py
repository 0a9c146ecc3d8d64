"""Every query with a SQL twin against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from quillspark.plans import registry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


def _value(v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 9))
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, ROOT)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(_value(r[c]) for c in columns) for r in got.collect())
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_value(r[i]) for i in places) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, ROOT).columns
