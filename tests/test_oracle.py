"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__
from lexigrove import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
