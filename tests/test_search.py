"""Stored postings: the rows of a full scan, from few files."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pressgrid.operators.search_index import index_months, runs_of, search_stored, stored_rows
from pressgrid.operators.views import search_articles
from pressgrid.schemas import conform


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "articles")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://src"), F.col("doc_id") % 30, F.lit(".example.com/"), "doc_id").alias("url"),
        F.concat(F.lit("src"), F.col("doc_id") % 30, F.lit(".example.com")).alias("domain"), F.substr("text", F.lit(1), F.lit(60)).alias("title"),
        F.col("text").alias("content"), F.when(F.col("doc_id") % 11 != 0, F.make_date(F.lit(2024), F.col("doc_id") % 3 + 1, F.lit(1))).alias("month"))
    odd = spark.createDataFrame([
        (9001, None, None, "ΟΔΟΣ and Straße", "İstanbul 100% sure_thing a\\b", None), (9002, "https://x.org/q", "x.org", None, None, dt.date(2024, 1, 1)),
        (None, "", "", "", "", None), (9002, "https://x.org/q", "x.org", None, None, dt.date(2024, 1, 1))],
        "id long, url string, domain string, title string, content string, month date")
    table = conform(docs.unionByName(odd))
    index_months(table, path, block_rows=20)
    return path, table


def listed(df):
    return sorted(map(str, df.select("id", "url", "title").collect()))


@pytest.mark.parametrize("term", [
    "that and", " THAT and ", "src7.example.com", "xa_ple.com/1%7", "9001", "οδος", "straße", "İSTANBUL", "100%", "sure_thing", "ab", "", "%", "nowhere to be found", "a\\\\b", "100\\%", "q"])
def test_same_rows_as_a_scan(spark, stored, term):
    path, table = stored
    assert listed(search_stored(spark, path, term)) == listed(search_articles(table, term))
    assert listed(search_stored(spark, path, term, ["url"])) == listed(search_articles(table, term, ["url"]))
    assert listed(search_stored(spark, path, term, ["domain"])) == listed(search_articles(table, term, ["domain"]))


def test_few_files_are_opened(spark, stored):
    path, _ = stored
    every = len(stored_rows(spark, path).inputFiles())
    assert every >= 8
    assert len(search_stored(spark, path, "src7.example.com/7").inputFiles()) <= every // 3
    assert search_stored(spark, path, "nowhere to be found").count() == 0


def test_one_month_anew(spark, stored, tmp_path):
    path, table = str(tmp_path / "t"), stored[1]
    index_months(table, path, block_rows=50)
    before = set(stored_rows(spark, path).inputFiles())
    january = table.filter("month = '2024-01-01'").withColumn("title", F.lit("changed headline"))
    index_months(january, path, block_rows=50)
    after = set(stored_rows(spark, path).inputFiles())
    assert {f for f in before if "m202401" not in f} == {f for f in after if "m202401" not in f}
    assert search_stored(spark, path, "changed head").count() == january.count()
    whole = table.filter("month is null or month <> '2024-01-01'").unionByName(january)
    assert listed(search_stored(spark, path, "that and")) == listed(search_articles(whole, "that and"))


def test_runs(spark):
    assert runs_of(spark, "Abcd_ef%ghi") == ["abc", "bcd", "ghi"] and runs_of(spark, "a%b") == []


def test_long_texts_take_time_in_proportion(spark, tmp_path):
    path = str(tmp_path / "long")
    body = "".join(f"é{k} \n😀" for k in range(120_000))  # about a million characters
    table = conform(spark.createDataFrame([(1, "https://a.org/1", "a.org", body), (2, "https://a.org/2", "a.org", "\n😀")], "id long, url string, domain string, content string"))
    began = time.monotonic()
    index_months(table, path, block_rows=1)
    assert time.monotonic() - began < 40
    for term in ("9 \n😀é1", "é119999 \n😀", "\n😀", "😀é7 "):
        assert listed(search_stored(spark, path, term)) == listed(search_articles(table, term)) != []
