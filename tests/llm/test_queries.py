"""Registered queries: held-out accuracy, and the SQL twin where there is one."""

import duckdb
import pytest

import __spark_entry__ as contract
from quizlens.llm.queries import ORACLE_SQL, QUERIES


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(name, spark, data):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    actual = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert actual == expected


def test_language_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op1_language_id"](spark, folder).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.98
