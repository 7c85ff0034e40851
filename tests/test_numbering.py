"""Numbers without sorting or storing texts, and pages that lose no row."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import lookup, ordering, views
from pressgrid.plans import enrich
from pressgrid.schemas import conform

T0 = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize("small", [True, False])
def test_numbers_of_rows_that_repeat(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "HOT_ROWS", 2)
    rng = random.Random(3)
    values = [(rng.choice([None, T0, T0 + dt.timedelta(hours=1)]), rng.choice([None, "a", "b"]), f"text {rng.randrange(3)}") for _ in range(400)]
    df = spark.createDataFrame(values, "at timestamp, url string, body string").repartition(7)
    got = ordering.number_by(df, ["at", "url"], F.asc_nulls_first("at"), F.asc_nulls_first("url"), name="n", start=5).collect()
    assert sorted(r["n"] for r in got) == list(range(5, 405))
    assert sorted(map(str, [tuple(r)[:3] for r in got])) == sorted(map(str, values))
    ranked = [(r["at"] is not None, r["at"] or T0, r["url"] is not None, r["url"] or "") for r in sorted(got, key=lambda r: r["n"])]
    assert ranked == sorted(ranked)


def held_columns(df):
    """Columns that exchanges, sorts and stored rows of a plan hold."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = re.findall(r"^\(\d+\) (\w+)[^\n]*\n(.*?)(?=^\(\d+\) |\Z)", plan, re.S | re.M)
    return {name.split("#")[0].strip() for kind, body in blocks if kind in ("Exchange", "Sort", "BroadcastExchange")
            for names in re.findall(r"Input \[\d+\]: \[(.*?)\]", body) for name in names.split(",")}


def test_bodies_are_neither_sorted_nor_stored(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "articles")
    rows = [(k if k % 3 else None, f"https://a.org/{k}", "body of some length, thing", T0 + dt.timedelta(minutes=k)) for k in range(50)]
    conform(spark.createDataFrame(rows, "id long, url string, content string, updated_at timestamp")).write.parquet(path)
    table = spark.read.parquet(path)
    kept = []
    settle = ordering.settle
    monkeypatch.setattr(ordering, "settle", lambda df: kept.extend(df.columns) or settle(df))
    none = {c: spark.createDataFrame([], s) for c, s in (
        ("people", "spokesperson_name string"), ("investors", "investor string, rank int"), ("reporters", "tagged_reporter string"),
        ("companies", "portco_name string, portco_location string, portco_deal_lead string, ai string, vehicle string"),
        ("media", "id long, domain string, country string, page_rank long, tier string"))}
    done = enrich.enrich_articles(table, enrich.Dictionaries(**none), "thble", F.lit(T0))
    assert done.filter("id is null").count() == 0
    for df in (done, ordering.stagger_timestamps(table, F.lit(T0), F.col("url"), by=["url"]), ordering.batches(table, 10, F.col("url"), by=["url"])):
        assert "content" not in held_columns(df) and "body" not in held_columns(df)
    assert kept and "content" not in kept
    wide = ordering.number_rows(table, F.col("url"))
    assert "content" in wide.columns  # the form that does store rows, for comparison


def test_pages_show_every_row_once(spark):
    rng = random.Random(1)
    values = [(k, rng.choice([None, "u1", "u2"]), rng.choice([None, T0, T0 + dt.timedelta(hours=2)])) for k in range(60)] + [(None, "u1", T0)]
    table = spark.createDataFrame(values, "id long, url string, updated_at timestamp")
    seen, last = [], None
    while part := views.page_after(table, last, 7).collect():
        seen += [tuple(r) for r in part]
        last = (part[-1]["updated_at"], part[-1]["url"], part[-1]["id"])
    assert sorted(map(str, seen)) == sorted(map(str, values))
    by_page = [tuple(r)[:3] for n in range(9) for r in views.page(table.withColumn("url", F.concat_ws("-", "url", "id")), n, 7).collect()]
    assert len(set(by_page)) == len(values)
    first = views.page(table, 0, 7).first()
    assert (first["total"], first["pages"]) == (61, 9)
    assert views.page(table.limit(0), 0).count() == 0 and views.page(table, 99).count() == 0
