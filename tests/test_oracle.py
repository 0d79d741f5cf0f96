"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
import os
from pathlib import Path

import pytest

from termloom.plans.queries import oracle_sql, queries

DATA = Path(os.environ.get("TERMLOOM_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    r = duck.execute(oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in row]) for row in r.fetchall())
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0
