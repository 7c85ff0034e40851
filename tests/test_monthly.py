"""Partial results per month: recounts, merged reports, bounded error, updates that leave other months alone."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import monthly, quality, transforms
from pressgrid.schemas import ARTICLES, conform
from pressgrid.sources.folders import fingerprints
from pressgrid.sources.tables import append_articles, swap_months

T0 = dt.datetime(2024, 6, 1)


def rows_of(spark, values):
    return conform(spark.createDataFrame(values, "id long, url string, content string, domain string, month date"))


@pytest.fixture
def table(spark, tmp_path):
    rng = random.Random(4)
    months = [None, dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    values = [(k, f"https://a.org/{k}", rng.choice([None, "", "text"]), rng.choice([None, "a.org", "b.org", f"d{k}.org"]), months[k // 50]) for k in range(200)]
    values.append((None, "https://a.org/x", "text", "a.org", months[3]))
    path = str(tmp_path / "t")
    append_articles(rows_of(spark, values), path)
    return path, str(tmp_path / "stats")


def stored(spark, path):
    return spark.read.schema(ARTICLES).parquet(path)


def same(a, b):
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def agree(spark, path, stats):
    same(monthly.stored_completeness_counts(spark, stats), quality.completeness_counts(stored(spark, path)))
    same(monthly.stored_fully_complete(spark, stats), quality.fully_complete(stored(spark, path)))
    same(monthly.stored_completeness_report(spark, stats), quality.completeness_report(stored(spark, path)))
    exact = quality.top_domains(stored(spark, path).filter("domain is not null"), 5)
    assert monthly.stored_top_domains(spark, stats, 2).collect() == exact.limit(2).collect()


def test_only_changed_months_are_read(spark, table, monkeypatch):
    path, stats = table
    assert len(monthly.refresh_months(spark, path, stats)) == 4 and monthly.refresh_months(spark, path, stats) == []
    agree(spark, path, stats)
    read = []
    plain = monthly.read_months
    monkeypatch.setattr(monthly, "read_months", lambda s, p, months: read.extend(months) or plain(s, p, months))
    swap_months(rows_of(spark, [(500 + k, f"https://n.org/{k}", "text", "n.org", dt.date(2024, 2, 1)) for k in range(70)]), path)
    assert monthly.refresh_months(spark, path, stats) == ["2024-02-01"] == read
    agree(spark, path, stats)
    append_articles(rows_of(spark, [(900, "https://n.org/900", None, None, None), (901, "https://n.org/901", None, None, dt.date(2024, 9, 1))]), path)
    assert monthly.refresh_months(spark, path, stats) == ["2024-09-01", monthly.NO_MONTH]
    agree(spark, path, stats)
    monthly.remove(spark, f"{path}/month=2024-01-01")
    assert monthly.refresh_months(spark, path, stats) == []
    agree(spark, path, stats)


def test_error_of_heavy_hitters_is_bounded(spark, tmp_path):
    rng = random.Random(6)
    months = [dt.date(2024, m, 1) for m in range(1, 5)]
    values = []
    for month in months:
        values += [(f"hot{int(rng.paretovariate(0.9)) % 40}.org" if rng.random() < 0.4 else f"rare{rng.randrange(10**9)}.org", month) for _ in range(3000)]
    df = conform(spark.createDataFrame(values, "domain string, month date").withColumn("url", F.lit("https://a.org/x")))
    path, stats = str(tmp_path / "t"), str(tmp_path / "s")
    append_articles(df, path)
    monthly.refresh_months(spark, path, stats, tracked=200)
    exact = {r["domain"]: r["n"] for r in df.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    bound = monthly.error_share(200) * len(values)
    got = monthly.stored_top_domains(spark, stats, 10, tracked=200).collect()
    assert len(got) == 10 and bound < 400
    assert all(abs(r["articles"] - exact.get(r["domain"], 0)) <= bound for r in got)
    frequent = {d for d, n in exact.items() if n > got[-1]["articles"] + 2 * bound}
    assert frequent and frequent <= {r["domain"] for r in got}


def test_an_update_leaves_other_months_alone(spark, table):
    path, stats = table
    edits = stored(spark, path).filter("id in (60, 70, 170)").withColumn("matched_portcos", F.lit("edited"))
    before, want = fingerprints(spark, path, "month"), stored(spark, path).select("id", "url", F.when(F.col("id").isin(60, 70, 170), "edited").alias("m")).collect()
    touched = monthly.change_rows(spark, path, stats, edits, lambda rows: transforms.edit_rows(rows, edits, F.lit(T0)))
    after = fingerprints(spark, path, "month")
    assert touched == ["2024-01-01", "2024-03-01"]
    assert {m for m in after if after[m] != before[m]} == set(touched)
    assert sorted(map(str, stored(spark, path).select("id", "url", F.col("matched_portcos").alias("m")).collect())) == sorted(map(str, want))
    agree(spark, path, stats)
    assert monthly.change_rows(spark, path, stats, spark.createDataFrame([(10**6,), (None,)], "id long"), lambda rows: rows) == []


def test_rows_that_move_to_another_month(spark, table):
    path, stats = table
    ids = spark.range(50, 100)
    before = sorted(r["id"] for r in stored(spark, path).filter("id is not null").collect())
    move = F.when(F.col("id").between(50, 98), F.lit("2024-03-01").cast("date")).when(F.col("id") == 99, F.lit("2024-07-01").cast("date")).otherwise(F.col("month"))
    assert monthly.change_rows(spark, path, stats, ids, lambda rows: rows.withColumn("month", move)) == ["2024-01-01", "2024-03-01", "2024-07-01"]
    assert sorted(r["id"] for r in stored(spark, path).filter("id is not null").collect()) == before
    assert set(fingerprints(spark, path, "month")) == {"2024-02-01", "2024-03-01", "2024-07-01", monthly.NO_MONTH}
    agree(spark, path, stats)
