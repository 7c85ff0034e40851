"""Appending by batches: repeated and broken jobs, rejects per batch, file to stored table."""

import pytest
from pyspark.sql import functions as F

from pressgrid.plans import intake
from pressgrid.schemas import ARTICLES, conform
from pressgrid.sources import folders
from pressgrid.sources.tables import append_batch, read_batches


def batch_of(spark, *rows):
    return conform(spark.createDataFrame(list(rows), "id long, url string, month date"))


def test_the_same_batch_twice_is_one_set_of_rows(spark, tmp_path):
    path, rejects = str(tmp_path / "t"), str(tmp_path / "r")
    rows = batch_of(spark, *[(k, f"https://a.org/{k}", None) for k in range(5)], (9, "no url", None), (8, None, None))
    assert read_batches(spark, path, ARTICLES).count() == 0
    for _ in range(2):
        assert append_batch(rows, path, "b1", rejects) == {"accepted": 5, "rejected": 2}
    more = rows.withColumns({"id": F.col("id") + 100, "month": F.lit("2024-05-01").cast("date")})
    append_batch(more, path, "b2", rejects)
    got = read_batches(spark, path, ARTICLES)
    assert got.schema == ARTICLES and sorted(r["id"] for r in got.collect()) == [0, 1, 2, 3, 4, 100, 101, 102, 103, 104]
    assert {(r["batch"], r["n"]) for r in spark.read.parquet(rejects).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {("b1", 2), ("b2", 2)}
    assert append_batch(rows.limit(0), path, "none") == {"accepted": 0, "rejected": 0}
    with pytest.raises(ValueError):
        append_batch(rows, path, "a/b")


def test_what_a_broken_job_left_is_not_read_and_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    append_batch(batch_of(spark, (1, "https://a.org/1", None)), path, "b1")
    append_batch(batch_of(spark, (2, "https://a.org/2", None), (3, "https://a.org/3", None)), path, "b2")
    folders.remove(spark, f"{path}/_ledger/batch=b2")  # as if the job had died before its last step
    assert [r["id"] for r in read_batches(spark, path, ARTICLES).collect()] == [1]
    append_batch(batch_of(spark, (2, "https://a.org/2", None)).withColumn("month", F.lit("2024-05-01").cast("date")), path, "b2")
    assert sorted(r["id"] for r in read_batches(spark, path, ARTICLES).collect()) == [1, 2]


def test_only_partitions_in_the_ledger_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    append_batch(batch_of(spark, (1, "https://a.org/1", None)), path, "b1")
    plan = read_batches(spark, path, ARTICLES).filter("month is null").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "isnull(month" in plan


def test_an_export_is_numbered_without_its_pages_and_prepared_once(spark, tmp_path, monkeypatch):
    """Texts of pages are not read for the numbers, and a batch in the ledger is not prepared again."""
    path, numbered, prepared = str(tmp_path / "t"), [], []
    number_by, intake_rows = intake.number_by, intake.intake_rows
    monkeypatch.setattr(intake, "number_by", lambda df, *a, **k: numbered.append(df.columns) or number_by(df, *a, **k))
    monkeypatch.setattr(intake, "intake_rows", lambda *a, **k: prepared.append(1) or intake_rows(*a, **k))
    urls = [(k, "" if k == 3 else f"https://a.org/{k}") for k in range(6)]
    spark.createDataFrame(urls, "line long, url string").write.option("header", True).csv(f"{path}/export")
    pages = spark.createDataFrame([(1, "https://a.org/4", "<title>Four</title><p>" + "some words " * 30 + "</p>")], "page_id long, url string, html string")
    media = spark.createDataFrame([(1, "a.org", "DE", "Tier 1")], "id long, domain string, country string, tier string")
    results = []
    for _ in range(2):
        done = intake.ingest_file(spark, f"{path}/export", f"{path}/articles", pages, media, "thble", F.lit("2025-01-01").cast("timestamp"), "b1")
        results.append(sorted((r["id"], r["url"], r["title"]) for r in done.collect()))
    assert results[0] == results[1] and [r[0] for r in results[0]] == [1, 2, 3, 4, 5]
    assert [r[2] for r in results[0] if r[1].endswith("/4")] == ["Four"]
    assert prepared == [1] and len(numbered) == 1 and not [c for c in numbered[0] if c.startswith("page_")]
    with pytest.raises(ValueError):
        intake.ingest_file(spark, f"{path}/export", f"{path}/articles", pages, media, "thble", F.current_timestamp(), "a/b")
