"""The driver contract, and every query with SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as e
from weftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v if isinstance(v, (bool, int, str)) or v is None else str(v)


def same(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = query(spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=key)
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=key)
    assert got == want, name


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])
