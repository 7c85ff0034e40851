"""Bulk intake of exports and the mention sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrid.functions.pages import extract_pages
from pressgrid.operators.joins import new_rows_only
from pressgrid.operators.lookup import lookup, salted_join
from pressgrid.operators.mentions import add_shares, match_mentions, mention_urls, relevant_mentions, url_counts
from pressgrid.operators.ordering import number_by
from pressgrid.operators.transforms import ingest_row_build
from pressgrid.plans.enrich import enrich_backlog
from pressgrid.schemas import ARTICLES, conform
from pressgrid.session import settle
from pressgrid.sources.files import HEADERS, read_delimited
from pressgrid.sources.tables import append_batch, appended, read_batches


def intake_rows(
    export: DataFrame, articles: DataFrame, pages: DataFrame, brand: str, as_of: Column,
) -> DataFrame:
    """Article rows for the export's unknown URLs, with fields from their pages; not yet enriched.

    Ids continue the table's and update times are a second apart, both in input
    order; one sort serves both.
    """
    fresh = new_rows_only(export, articles)
    fresh = settle(fresh)
    # which pages are needed follows from narrow columns; only those are parsed
    needed = settle(
        lookup(pages.select("url", "page_id"), fresh.select("url").filter("url IS NOT NULL").distinct(), "url", "left_semi")
        .groupBy("url").agg(F.min("page_id").alias("page_id")))
    picked = lookup(pages, needed.withColumnRenamed("url", "_url"), "page_id", "inner", spread=["url"]).filter(F.col("url") == F.col("_url"))
    fields = extract_pages(picked.drop("_url"), "light", as_of, [brand]).dropDuplicates(["url"]).select(
        "url", F.col("title").alias("page_title"), F.col("publish_date").alias("page_date"),
        F.col("domain").alias("page_domain"), F.col("content").alias("page_content"))
    # numbered before the page fields come in, so that no page is parsed for the numbers
    numbered = number_by(fresh, ["pos"], F.col("pos"), name="_n")
    joined = salted_join(numbered, fields, "url")
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    built = ingest_row_build(joined.withColumn("id", F.col("_n")), brand, as_of)
    return built.withColumns({
        "updated_at": as_of + F.make_interval(secs=F.col("id")),
        "id": F.col("id") + 1 + top,
    })


def bulk_ingest(
    export: DataFrame, articles: DataFrame, pages: DataFrame, media: DataFrame, brand: str, as_of: Column,
) -> DataFrame:
    """The table with the export's new articles appended and every row enriched."""
    table = conform(articles)
    added = conform(intake_rows(export, table, pages, brand, as_of))
    return enrich_backlog(table.unionByName(added), media, brand, as_of)


def ingest_file(
    spark: SparkSession, file: str, path: str, pages: DataFrame, media: DataFrame, brand: str, as_of: Column, batch: str,
    rejects: str | None = None,
) -> DataFrame:
    """An export file into the stored table at `path`, read back and enriched.

    The rows of the file that the table lacks are appended as one batch, so a
    job that is run again adds nothing: a batch in the ledger is not prepared anew. Rows go in the
    order of the file's `line` column where it has one.
    """
    if not appended(spark, path, batch):
        table = read_batches(spark, path, ARTICLES)
        lines = read_delimited(spark, file, HEADERS | {"line": ["line"]})
        export = lines.withColumn("pos", F.coalesce(F.expr("try_cast(line AS BIGINT)"), F.col("pos"))).drop("line")
        append_batch(conform(intake_rows(export, table, pages, brand, as_of)), path, batch, rejects)
    return enrich_backlog(read_batches(spark, path, ARTICLES), media, brand, as_of)


def sync_mentions(
    mentions: DataFrame, articles: DataFrame, brand: str, as_of: Column, **options,
) -> tuple[DataFrame, DataFrame]:
    """(articles with raised share counts, one audit row per matched mention URL)."""
    # both are used several times below and are narrow: written once instead of recomputed
    counts = settle(url_counts(mention_urls(relevant_mentions(mentions, brand, **options))))
    matches = settle(match_mentions(counts, articles))
    updated = add_shares(articles, matches)
    totals = updated.filter(F.col("id").isNotNull()).select("id", F.col("social_shares_count").alias("new_total"))
    audit = lookup(totals, matches, "id", "inner").select(
        as_of.alias("ts"), F.col("id").alias("article_id"), "article_url", "mention_url",
        F.col("shares").alias("shares_added"), "new_total", "match_kind")
    return updated, audit
