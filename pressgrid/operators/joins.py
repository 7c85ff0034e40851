"""Existence checks and dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.urls import normalize_domain, normalize_url
from pressgrid.operators.lookup import is_small, lookup, salted_join


def known_keys(table: DataFrame, key: Column, wanted: DataFrame, name: str = "_key") -> DataFrame:
    """The wanted keys a table holds, each once.

    A batch of wanted keys that is measured small goes to the table, so the
    table's keys are only scanned; otherwise they are made distinct map-side first.
    """
    keys = table.select(key.alias(name)).filter(F.col(name).isNotNull())
    if is_small(wanted):
        keys = keys.join(F.broadcast(wanted), name, "left_semi")
    return keys.distinct()


def existing_urls(urls: DataFrame, articles: DataFrame, how: str = "left_semi") -> DataFrame:
    """Input rows, as spelled, whose normalised URL is in the table."""
    keyed = urls.withColumn("_key", normalize_url(F.col("url")))
    known = known_keys(articles, F.col("url"), keyed.select("_key").distinct())
    return salted_join(keyed, known, "_key", how).drop("_key")


def new_rows_only(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Input rows whose normalised URL is not in the table; rows without a URL are dropped."""
    filled = rows.filter(F.trim(F.col("url")) != "")
    return existing_urls(filled, articles, "left_anti")


def classify_urls(urls: DataFrame, articles: DataFrame, queue: DataFrame) -> DataFrame:
    """Each distinct normalised URL as in_main_table, in_queue or new."""
    wanted = urls.select(normalize_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    main = known_keys(articles, F.col("url"), wanted, "url").withColumn("_main", F.lit(True))
    queued = known_keys(queue, F.col("url"), wanted, "url").withColumn("_queued", F.lit(True))
    status = F.when(F.col("_main"), "in_main_table").when(F.col("_queued"), "in_queue").otherwise("new")
    # all three sides hold each URL once: no key can be hot
    return wanted.join(main, "url", "left").join(queued, "url", "left").select("url", status.alias("status"))


def one_per_domain(media: DataFrame, key: Column, cols: list[str]) -> DataFrame:
    """The dimension with one row per join key (smallest id)."""
    return (
        media.groupBy(key.alias("_domain"))
        .agg(F.min_by(F.struct(*[F.col(c).alias(f"_{c}") for c in cols]), "id").alias("_d"))
        .filter(F.col("_domain").isNotNull()).select("_domain", "_d.*")
    )


def domain_lookup(articles: DataFrame, media: DataFrame, key: list[str], apply: Column | None = None) -> DataFrame:
    """Country, page rank and tier by normalised domain, only where NULL (and where `apply` holds)."""
    cols = ["country", "page_rank", "tier"]
    dim = one_per_domain(media, normalize_domain(F.col("domain")), cols)
    fact = articles.withColumn("_domain", normalize_domain(F.coalesce("domain", F.lit(""))))
    allowed = F.lit(True) if apply is None else apply
    joined = lookup(fact, dim, "_domain", spread=key)
    filled = {c: F.coalesce(F.col(c), F.when(allowed, F.col(f"_{c}"))) for c in cols}
    return joined.withColumns(filled).select(*articles.columns)


def domain_lookup_exact(articles: DataFrame, media: DataFrame, key: list[str]) -> DataFrame:
    """Country and tier by the domain as stored, both overwritten where either is ''."""
    cols = ["country", "tier"]
    dim = one_per_domain(media, F.col("domain"), cols).withColumn("_hit", F.lit(True))
    joined = lookup(articles.withColumn("_domain", F.col("domain")), dim, "_domain", spread=key)
    due = F.col("_hit") & ((F.col("country") == "") | (F.col("tier") == ""))
    return joined.withColumns(
        {c: F.when(due, F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).select(*articles.columns)
