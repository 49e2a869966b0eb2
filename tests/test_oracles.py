"""Every query with oracle SQL gives the rows of DuckDB at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    cursor = duck.execute(entry.catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
