"""Every query of the catalogue and of the engine against DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from plumbline import catalog, engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalog.QUERIES | engine.QUERIES
SQL = catalog.ORACLE_SQL | engine.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def sorted_rows(rows, names):
    order = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    held = duck.execute(SQL[name])
    names = [c[0] for c in held.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows([tuple(r) for r in df.collect()], df.columns) == sorted_rows(held.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
