"""Every registered query against its independent SQL."""

import duckdb
import pytest
from helpers import rows, value

import __spark_entry__ as entry
from trainlake.plans.catalog import QUERIES
from trainlake.plans.oracle import ORACLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def database(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, database, name):
    found = entry.queries()[name](spark, data)
    expected = database.sql(entry.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in found.dtypes} == kinds
    wanted = [tuple(value(x) for x in r) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall()]
    wanted.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    assert rows(found, columns) == wanted
    assert wanted, "a query without rows shows nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
