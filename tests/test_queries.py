"""Every registered query that has SQL gives what DuckDB gives, as a multiset of rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.collect()) > 0 or name in {"dc6_objections", "dc7_failures"}


def test_entry(spark):
    assert entry.entry(spark).count() == duckdb.sql(f"SELECT count(DISTINCT conv_id) AS n FROM '{SF}/conversations.parquet'").fetchall()[0][0]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_data_in_the_repository():
    assert not [f for f in os.listdir(os.path.dirname(entry.__file__)) if f.endswith(".parquet")]
