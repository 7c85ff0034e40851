"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from pressgrid.checks.registry import ORACLES, QUERIES
from pressgrid.checks.views import TABLES
from pressgrid.operators import dictionary, lookup

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = [tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = canonical(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1]
        return
    result = duck.sql(ORACLES[name])
    assert got == canonical([c[0] for c in result.description], result.fetchall())


LARGE = [
    "existing_urls", "new_rows_only", "classify_urls", "domain_lookup", "domain_lookup_exact", "distinct_concat", "impute_domain",
    "match_mentions_exact", "match_mentions_partial", "sync_mentions", "update_content", "apply_scrape_result", "bulk_set",
    "delete_by_url", "delete_by_pattern", "count_deleted", "queue_add", "flawed_articles", "enrich_articles",
]


@pytest.mark.parametrize("name", LARGE)
def test_query_without_broadcasts(spark, duck, monkeypatch, name):
    """The same results when nothing counts as small and keys are hot from three rows on."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup, "HOT_ROWS", 2)
    monkeypatch.setattr(dictionary, "INLINE_ROWS", 0)
    test_query(spark, duck, name)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
