"""Queries that number the lines of whole texts give the rows of DuckDB where texts are empty, blank or end with a line break."""

from __future__ import annotations

import shutil

import pytest

import __spark_entry__ as entry
from test_oracles import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
CHUNKS = ["changed_corpus_statistics", "chunk_identity", "postings", "project_totals", "recovered_files", "stored_chunks", "term_stats"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The folder of the tables, and a connection to them."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        if t != "documents":
            shutil.copy(DATA / f"{t}.parquet", folder)
    text = "CASE WHEN doc_id % 40 IN (3, 9) THEN '' WHEN doc_id % 40 = 29 THEN 'one' WHEN doc_id % 40 = 5 THEN chr(10) WHEN doc_id % 40 = 7 THEN 'end' || chr(10) WHEN doc_id % 40 = 13 THEN chr(10) || chr(10) ELSE text END"
    con.execute(f"COPY (SELECT * REPLACE ({text} AS text) FROM read_parquet('{DATA}/documents.parquet')) TO '{folder}/documents.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return folder, con


def _same(spark, tables, name):
    folder, con = tables
    df = entry.catalog.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    cursor = con.execute(entry.catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", CHUNKS)
def test_whole_chunks(spark, tables, name):
    _same(spark, tables, name)


@pytest.mark.parametrize("name", ["prioritized_files", "project_trees"])
def test_files_of_projects(spark, tables, name):
    _same(spark, tables, name)
