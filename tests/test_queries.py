import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
duckdb = pytest.importorskip("duckdb")
queries = importlib.import_module("pairsift.queries").QUERIES
oracles = importlib.import_module("pairsift.oracles").ORACLES


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(oracles) == set(queries)


@pytest.mark.parametrize("name", sorted(oracles))
def test_equals_sql(spark, sql, name):
    frame = queries[name](spark, SF)
    found = sql.sql(oracles[name])
    names = sorted(frame.columns)
    assert sorted(found.columns) == names
    got = sorted(repr([row[c] for c in names]) for row in frame.collect())
    want = sorted(repr([row[found.columns.index(c)] for c in names]) for row in found.fetchall())
    assert got == want
    spark.catalog.clearCache()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
