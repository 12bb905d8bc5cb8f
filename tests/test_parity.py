"""Every registered query with a DuckDB twin gives the twin's rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
