"""Queries of this subpackage that SQL can state, against that SQL, on the tables that the oracle is meant for."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("embeddings", "conversations", "documents"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = connection.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted((tuple(r) for r in got.select(expected.columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)
