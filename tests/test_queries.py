"""Every query with SQL against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from galena.plans.queries import QUERIES
from galena.plans.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(got.columns)
    table = want.select(*(f'"{c}"' for c in columns)).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key) == sorted((tuple(map(plain, r)) for r in table), key=key)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
