"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(small):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    own = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert own == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"linear_engine"}))  # that one has a test of its accuracy
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0
