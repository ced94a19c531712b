import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["scan_articles", "porter_stem_vocab", "search_tfidf", "crawl_progress"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{SMALL}/{t}')")
    expected = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    assert names == sorted(expected.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    assert got == sorted(map(repr, expected.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()))
