"""Operators' queries against their SQL in DuckDB, on the given tables and on odd ones."""

import os
from collections import Counter

import duckdb
import pytest

from dialoom.llm.queries import ORACLE_SQL, QUERIES


_SAID = ["Hello.", "Hello.", "What?", "", " \t", None, "no end", "Wait!  ", "日本。", "Hello.", "x" * 50_000 + "."]
ODD_TURNS = [
    (c if c < 28 else None, t if (c + t) % 11 else None, (["user", "assistant", "system", None, "", "usher", "assistant"] if c % 3 else ["user", "assistant"])[(t * (c % 5 + 1) + c) % (7 if c % 3 else 2)], _SAID[(c * 7 + t * 3) % len(_SAID)], "x", "y")
    for c in range(30) for t in [*range(c % 9 + 1), *([2, 2, 40] if c % 4 == 0 else [])]
]


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


def same(spark, name, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}')")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = Counter(tuple(map(plain, r)) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want
    return want


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows(spark, sf, name):
    assert same(spark, name, sf)
    assert same(spark, name, "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows_of_odd_tables(spark, odd, empty, tmp_path, name):
    pages = odd.selectExpr("doc_id AS page_id", "'u' AS url", "repeat(text, 40) AS html")
    turns = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string, fault string, gone string")
    items = odd.selectExpr("doc_id AS item_id", "text", "score AS rank").dropDuplicates(["item_id", "text"])
    for at, docs, rows, convs, asked in (("odd", odd, pages, turns, items), ("empty", empty, pages.limit(0), turns.limit(0), items.limit(0))):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        rows.coalesce(1).write.parquet(f"{tmp_path}/{at}/pages.parquet")
        convs.coalesce(1).write.parquet(f"{tmp_path}/{at}/conversations.parquet")
        asked.coalesce(1).write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        assert bool(same(spark, name, f"{tmp_path}/{at}")) == (at == "odd")
