"""Queries over training text against their SQL, and the SQL-less ones by shape."""

import duckdb
import pytest

import __spark_entry__ as entry
from pressgrid.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = [tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(text)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    result = duck.sql(ORACLES[name])
    assert got == canonical([c[0] for c in result.description], result.fetchall())


def test_all_thirteen_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_native_queries_have_no_python(spark):
    for name in ("op1_extendible_sharding", "op2_secret_scan"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "Arrow" not in plan and "Python" not in plan
