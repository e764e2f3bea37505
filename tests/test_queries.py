"""Every map query runs, and equals its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from quillmap.plans import queries as maps

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(maps.QUERIES))
def test_query(spark, con, name):
    df = maps.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name in maps.SQL:
        want = con.sql(maps.SQL[name])
        at = [want.columns.index(c) for c in cols]
        assert len(want.columns) == len(cols)
        assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
