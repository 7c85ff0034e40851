"""Filters, top-k lists, search, paging and display views."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pressgrid.functions.text import PLACEHOLDER, as_text, shorten, yes_no
from pressgrid.functions.urls import is_paywalled
from pressgrid.operators.lookup import lookup


def newest(df: DataFrame, n: int, by: str = "updated_at", tie: str = "url") -> DataFrame:
    """Top n by a time column, newest first, NULL last; the tie column keeps it reproducible."""
    return df.orderBy(F.desc_nulls_last(by), F.asc_nulls_first(tie)).limit(n)


def oldest(df: DataFrame, n: int, by: str = "updated_at", tie: str = "url") -> DataFrame:
    """Top n by a time column, oldest first (NULL first)."""
    return df.orderBy(F.asc_nulls_first(by), F.asc_nulls_first(tie)).limit(n)


def recent_records(articles: DataFrame, n: int = 5) -> DataFrame:
    return newest(articles, n).select(
        "id", "updated_at", "publish_date", "url", "domain", shorten(F.col("title"), 50, "No title").alias("title"),
        "matched_spokespeople", "matched_reporter", yes_no(F.col("tagged_brand")).alias("tagged_brand"), "language")


def tagging_status(articles: DataFrame, n: int = 10) -> DataFrame:
    return newest(articles, n).select(
        "id", shorten(F.col("url"), 60).alias("url"), shorten(F.col("title"), 40).alias("title"),
        F.when(F.coalesce("tagged_brand", F.lit(False)), "TRUE").otherwise("FALSE").alias("tagged_brand"),
        shorten(F.col("matched_spokespeople"), 30, "None").alias("matched_spokespeople"),
        shorten(F.col("matched_portcos"), 30, "None").alias("matched_portcos"))


def recent_logs(log: DataFrame, n: int = 20, tie: str = "seq") -> DataFrame:
    return newest(log, n, "ts", tie).select(
        F.when(F.col("run_id").isNull() | (F.col("run_id") == ""), "N/A")
        .otherwise(F.concat(F.substr("run_id", F.lit(1), F.lit(8)), F.lit("..."))).alias("run_id"),
        shorten(F.col("url"), 50, "N/A").alias("url"), "step", "severity",
        F.coalesce(shorten(F.col("context"), 100), F.lit("")).alias("context"), "ts")


def step_errors(log: DataFrame, step: str, n: int = 10, tie: str = "seq") -> DataFrame:
    failed = log.filter((F.col("step") == step) & (F.col("severity") == "ERROR"))
    return newest(failed, n, "ts", tie).select(
        F.concat(F.substr("run_id", F.lit(1), F.lit(8)), F.lit("...")).alias("run_id"),
        shorten(F.col("url"), 60, "N/A").alias("url"), as_text(F.col("context"), "No context").alias("context"), "ts")


# An article lacking one of these goes through enrichment again;
# for the second list '' counts as lacking too.
REPROCESS_NULL = [
    "id", "tagged_brand", "language", "tier", "kill_pill", "kill_pill_count", "brand_in_headline",
    "unwanted_count", "cleaned_url", "unwanted",
]
REPROCESS_EMPTY = ["language", "tier", "cleaned_url"]


def lacks_any(nulls: list[str], empties: list[str]) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in nulls] + [F.col(c) == "" for c in empties])


def needs_reprocessing(articles: DataFrame, n: int = 20) -> DataFrame:
    """Articles with an unfilled enrichment field, newest first, as a status list."""
    def mark(c: str) -> Column:
        return F.when(F.col(c), "yes").otherwise("no").alias(c)

    def shown(c: str) -> Column:
        return as_text(F.col(c), "no").alias(c)

    return newest(articles.filter(lacks_any(REPROCESS_NULL, REPROCESS_EMPTY)), n).select(
        "url", shorten(F.col("title"), 40, "No title").alias("title"), "domain",
        F.coalesce(F.col("id").cast("string"), F.lit("Missing")).alias("id"),
        mark("tagged_brand"), shown("language"), shown("tier"), mark("kill_pill"), mark("brand_in_headline"),
        F.when(F.coalesce("cleaned_url", F.lit("")) != "", "yes").otherwise("no").alias("cleaned_url"))


def unscraped(articles: DataFrame, n: int = 500) -> DataFrame:
    blank = F.col("content").isNull() | (F.trim("content") == "")
    return newest(articles.filter(blank), n).select("id", "url", as_text(F.col("title"), "No title").alias("title"), "domain")


def missing_content_by_id(articles: DataFrame, n: int = 50) -> DataFrame:
    missing = (F.col("content").isNull() | (F.col("content") == "")) & F.col("url").isNotNull()
    return articles.filter(missing).orderBy(F.asc_nulls_first("id"), "url").limit(n).select("id", "url")


def missing_or_placeholder(articles: DataFrame, n: int = 50) -> DataFrame:
    missing = F.col("content").isNull() | (F.trim("content") == "") | (F.col("content") == PLACEHOLDER)
    return articles.filter(missing).orderBy(F.desc_nulls_last("id"), "url").limit(n).select("id", "url", "domain")


def is_flawed(low: int, high: int) -> Column:
    short = (
        (F.col("content") == PLACEHOLDER) | F.col("content").isNull() | (F.col("content") == "")
        | (F.length("content") < 100)
    )
    return F.col("id").between(low, high) & short


def flawed_articles(articles: DataFrame, low: int, high: int, skip: DataFrame, n: int = 100) -> DataFrame:
    """Unusable bodies in an id range, without the ids that failed before (`skip.id`, distinct)."""
    flawed = articles.filter(is_flawed(low, high)).select("id", "url", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("content_length"))
    return lookup(flawed, skip.select("id").distinct(), "id", "left_anti").orderBy("id", "url").limit(n)


def placeholder_brand(articles: DataFrame, brand: str, n: int = 100) -> DataFrame:
    return articles.filter(F.trim("content") == brand).orderBy("id", "url").limit(n).select("id", "url")


def pending_text(articles: DataFrame, n: int = 50) -> DataFrame:
    return oldest(articles.filter(~F.col("text_scraped")), n).select("url", "title", "domain", "publish_date")


def ingest_flagged(articles: DataFrame, n: int = 50) -> DataFrame:
    """Rows waiting for their body by id, each with the number waiting in all."""
    waiting = articles.filter("data_ingestion")
    total = waiting.agg(F.count("*")).scalar()
    return (
        waiting.orderBy(F.asc_nulls_first("id"), "url").limit(n)
        .select("id", "url", "domain").withColumn("remaining", total)
    )


def recent_window(articles: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    return articles.filter(F.col("updated_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def recent_activity(articles: DataFrame, n: int = 10) -> DataFrame:
    kind = F.when(F.length("content") > 0, "Full Scrape").otherwise("Quick Scrape")
    return newest(articles.filter(F.col("updated_at").isNotNull()), n).select(
        "id", "url", as_text(F.col("title"), "No title").alias("title"), "domain", "updated_at", kind.alias("scrape_type"))


def pending_queue(queue: DataFrame, n: int = 20, hide: str = "example.com") -> DataFrame:
    """Open queue entries, newest first, then without the test hosts."""
    opened = queue.filter(F.col("status").isin("pending", "processing"))
    return newest(opened, n, "updated_at", "id").filter(~F.col("url").contains(hide)).select(
        "id", "url", "status", "updated_at", "batch_name")


SEARCH_FIELDS = ["url", "title", "matched_portcos", "content"]


def search_articles(articles: DataFrame, term: str, fields: list[str] | None = None) -> DataFrame:
    """Case-insensitive pattern over id and text fields; % and _ in the term are wildcards."""
    term = term.strip()
    if not term:
        return articles
    pattern = f"%{term}%"
    tests = [F.col("id").cast("string").like(pattern)] + [F.col(c).ilike(pattern) for c in fields or SEARCH_FIELDS]
    return articles.filter(reduce(or_, tests))


def page(df: DataFrame, number: int, size: int = 50, by: str = "updated_at", tie: str = "url") -> DataFrame:
    """One page (from 0) with the total and the number of pages on every row.

    Rows are found once: they are counted while the page is picked, and only the page is kept.
    """
    counted = Observation()
    shown = df.observe(counted, F.count("*").alias("n")).orderBy(F.desc_nulls_last(by), F.asc_nulls_first(tie)).limit((number + 1) * size)
    rows = shown.offset(number * size).collect()  # `size` rows at most
    total = counted.get["n"]
    return df.sparkSession.createDataFrame(rows, df.schema).withColumns({
        "total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})


def page_after(
    df: DataFrame, after: tuple | None, size: int = 50, by: str = "updated_at", tie: str = "url", unique: str | None = "id",
) -> DataFrame:
    """Keyset form for deep pages: rows following the last (time, tie, id) seen; cost does not grow with depth.

    Newest first, rows without a time last; then by tie and id, null first. A cursor of
    (time, tie) alone goes on behind all rows of that time and tie.
    """
    keys = [by, tie] + ([unique] if unique else [])
    if after is not None:
        def behind(column: str, value) -> Column:
            return F.col(column).isNotNull() if value is None else F.col(column) > F.lit(value)

        following = F.lit(False)
        for column, value in reversed(list(zip(keys, after))[1:]):
            following = behind(column, value) | (F.col(column).eqNullSafe(F.lit(value)) & following)
        when = F.lit(after[0])
        older = F.lit(False) if after[0] is None else (F.col(by) < when) | F.col(by).isNull()
        df = df.filter(older | (F.col(by).eqNullSafe(when) & following))
    return df.orderBy(F.desc_nulls_last(by), *(F.asc_nulls_first(c) for c in keys[1:])).limit(size)


def point_lookup(articles: DataFrame, url: str | None = None, row_id: int | None = None, id_range: tuple | None = None) -> DataFrame:
    """Rows by URL, id or id range; each test reaches the scan."""
    tests = []
    if url is not None:
        tests.append(F.col("url") == url)
    if row_id is not None:
        tests.append(F.col("id") == row_id)
    if id_range is not None:
        tests.append(F.col("id").between(*id_range))
    return articles.filter(reduce(or_, tests))


def false_entries(articles: DataFrame, test_domain: str, as_of: Column) -> DataFrame:
    """One row per row and reason for suspicion, from a single scan."""
    reasons = F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("null_id")),
        F.when(F.col("domain") == test_domain, F.lit("test_domain")),
        F.when(F.col("data_ingestion"), F.lit("flagged_ingest")),
        F.when(F.col("updated_at") >= as_of - F.make_interval(hours=F.lit(2)), F.lit("recent")),
    ))
    return articles.select("id", "url", "updated_at", F.explode(reasons).alias("reason"))


def content_preview(articles: DataFrame, n: int = 10, below: int | None = None) -> DataFrame:
    """Newest rows with the length of their content; `below` keeps only shorter ones."""
    size = F.length(F.coalesce("content", F.lit(""))).cast("long")
    rows = articles if below is None else articles.filter(size < below)
    return newest(rows, n).select("url", "title", "domain", "updated_at", size.alias("content_length"))


def sample_rows(df: DataFrame, condition: Column, key: str, seed: str, n: int = 1) -> DataFrame:
    """n rows in an order fixed by the seed: random enough, the same on every run, no global shuffle."""
    draw = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return df.filter(condition).orderBy(draw, F.asc_nulls_first(key)).limit(n)


def route_paywalled(df: DataFrame, match: str = "substring") -> DataFrame:
    return df.withColumn("route", F.when(is_paywalled(F.col("url"), match), "paywalled").otherwise("standard"))
