"""Every query against its SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from dialoom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == rows
    assert rows
