"""Every query gives the rows its SQL twin gives on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from quizlens import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
QUERIES, SQL = catalog.QUERIES, contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    result = duck.execute(SQL[name])
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    names = sorted(kinds)
    order = [list(kinds).index(n) for n in names]
    expected = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=repr)
    actual = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    assert actual == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 9
