"""Every registered query of the library against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from pulsegrid import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.execute(SQL[name])
    cols = sorted(d[0] for d in rel.description)
    want = rel.fetchall()
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(got.columns) == cols
    rows = lambda it: sorted((tuple(plain(v) for v in r) for r in it), key=str)
    assert rows([r[c] for c in cols] for r in got.collect()) == rows([r[at[c]] for c in cols] for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
