"""Completeness, duplicate and status counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.schemas import QUEUE_STATES, REQUIRED_FIELDS


def filled(name: str, blank_is_missing: bool) -> Column:
    present = F.col(name).isNotNull()
    return present & (F.col(name) != "") if blank_is_missing else present


def is_complete() -> Column:
    """All required fields filled (never NULL)."""
    return F.coalesce(reduce(and_, [filled(n, b) for n, _, b in REQUIRED_FIELDS]), F.lit(False))


def completeness_counts(articles: DataFrame) -> DataFrame:
    """Total and one count per required field, in one scan and one aggregate."""
    counts = [F.count_if(filled(n, b)).alias(f"has_{n}") for n, _, b in REQUIRED_FIELDS]
    return articles.agg(F.count("*").alias("total"), *counts)


def fully_complete(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("total"), F.count_if(is_complete()).alias("fully_complete"),
        F.count_if(F.col("data_ingestion")).alias("pending_scrape"))


def completeness_report(articles: DataFrame) -> DataFrame:
    """Long form: field, type, filled, missing, rounded per cent (0 for an empty table)."""
    return report_of(completeness_counts(articles))


def report_of(counts: DataFrame) -> DataFrame:
    """The long form of one row of `completeness_counts`."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), F.lit(t).alias("type"),
                 F.col(f"has_{n}").alias("filled"))
        for i, (n, t, _) in enumerate(REQUIRED_FIELDS, 1)
    ]))
    percent = F.coalesce(F.round(F.try_divide(F.col("filled") * 100.0, F.col("total"))), F.lit(0.0))
    return counts.select("total", rows.alias("r")).select(
        "r.*", "total").select(
        "position", "field", "type", "filled", (F.col("total") - F.col("filled")).alias("missing"),
        percent.cast("long").alias("percent"))


def mark_complete(articles: DataFrame) -> DataFrame:
    return articles.withColumn("is_complete", is_complete())


def top_domains(articles: DataFrame, n: int = 10) -> DataFrame:
    return articles.groupBy("domain").agg(F.count("*").alias("articles")) \
        .orderBy(F.desc("articles"), F.asc_nulls_first("domain")).limit(n)


def duplicate_urls(articles: DataFrame, n: int = 50) -> DataFrame:
    return articles.groupBy("url").agg(F.count("*").alias("copies")).filter("copies > 1") \
        .orderBy(F.desc("copies"), "url").limit(n)


def input_duplicates(urls: DataFrame) -> DataFrame:
    """URLs repeated in an input, with the number of surplus rows in the whole input."""
    counted = urls.groupBy("url").agg(F.count("*").alias("copies"))
    surplus = counted.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).scalar()
    return counted.filter("copies > 1").withColumn("surplus_rows", surplus)


def queue_status(queue: DataFrame) -> DataFrame:
    """Per batch a count of each of the four states, 0 where none."""
    return queue.groupBy("batch_name").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATES])


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def batch_progress(queue: DataFrame, hide: str = "test_batch") -> DataFrame:
    """Batches with open work: total, processed and their ratio."""
    total = reduce(lambda a, b: a + b, [F.col(s) for s in QUEUE_STATES])
    processed = F.col("completed") + F.col("failed")
    return (
        queue_status(queue.filter(F.col("batch_name") != hide))
        .filter((F.col("pending") > 0) | (F.col("processing") > 0))
        .select("batch_name", total.alias("total"), processed.alias("processed"),
                F.round(F.try_divide(processed.cast("double"), total), 4).alias("progress"))
    )


def content_buckets(articles: DataFrame) -> DataFrame:
    size = F.length(F.coalesce("content", F.lit("")))
    return articles.agg(
        F.count("*").alias("total"), F.count_if(size == 0).alias("empty_content"),
        F.count_if(size < 100).alias("minimal_content"), F.count_if(size >= 100).alias("full_content"))


def max_id(table: DataFrame, name: str = "id") -> DataFrame:
    return table.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("max_id"))


def batch_outcome(queue: DataFrame) -> DataFrame:
    """Success, failure and error counts with the success rate in per cent."""
    done = F.count_if(F.col("status") == "completed")
    rate = F.round(F.coalesce(F.try_divide(done * 100.0, F.count("*")), F.lit(0.0)), 1)
    return queue.agg(
        F.count("*").alias("total"), done.alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("error_message").isNotNull()).alias("errors"), rate.alias("success_rate"))


def verify_counts(articles: DataFrame, test_domain: str) -> DataFrame:
    return articles.agg(
        F.count("*").alias("total_rows"), F.count_if(F.col("id").isNull()).alias("null_ids"),
        F.count_if(F.col("domain") == test_domain).alias("test_rows"))


def ingest_summary(intake: DataFrame) -> DataFrame:
    """Outcome counts over the input rows, from one row per URL with its `copies` and `decision`."""
    n, decision = F.col("copies"), F.col("decision")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return intake.agg(
        F.count_if(decision == "added").alias("added"),
        total(F.when(decision == "added", n - 1).when(decision == "duplicate", n)).alias("skipped_duplicates"),
        total(F.when(decision == "own_site", n)).alias("skipped_own_site"),
        total(n).alias("total_input"))


def distinct_concat(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """STRING_AGG(DISTINCT value, ', ') per key in value order.

    Values are made distinct before they are gathered, so only distinct ones travel.
    """
    distinct = df.filter(F.col(value).isNotNull()).select(*key, value).distinct()
    return distinct.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias(out))
