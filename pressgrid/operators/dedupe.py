"""Removing repeated URLs by keeping the most complete row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.operators.lookup import lookup
from pressgrid.operators.ordering import rank_within
from pressgrid.session import settle

# The columns whose presence makes a row more complete.
SCORED = [
    "title", "domain", "content", "publish_date", "matched_portcos", "matched_spokespeople", "tagged_brand",
    "unbranded_win",
]
HOLD_BACK_MINUTES = 90


def fill_score() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in SCORED), F.lit(0))


def rank_duplicates(articles: DataFrame) -> DataFrame:
    """Rows of repeated URLs ranked by completeness, then recency, then id; bodies stay behind."""
    narrow = articles.select("id", "url", "updated_at", fill_score().alias("filled_columns"))
    ranked = rank_within(
        narrow, "url", F.desc("filled_columns"), F.desc_nulls_last("updated_at"), F.asc_nulls_first("id"),
        rank="rank", size="url_count")
    return ranked.filter("url_count > 1")


def dedupe_keep_best(articles: DataFrame, as_of: Column, minutes: int = HOLD_BACK_MINUTES) -> DataFrame:
    """The best row per URL, plus every row too fresh to be removed yet.

    Fresh rows and rows whose URL occurs once come straight from the scan: the
    aggregate that counts URLs has no bodies. Only rows of repeated URLs are
    compared, combined map-side, so a URL with very many copies has shrunk to
    one row per task before it is shuffled.
    """
    cutoff = as_of - F.make_interval(mins=F.lit(minutes))
    fresh = F.coalesce(F.col("updated_at") > cutoff, F.lit(False))
    # larger is better; the smallest id wins a tie, NULL before all others
    order = F.struct(
        fill_score().alias("s"), F.col("updated_at").alias("t"), F.col("id").isNull().alias("n"), (-F.col("id")).alias("i"))
    repeated = settle(
        articles.filter(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("_n")).filter("_n > 1").select("url"))
    alone = lookup(articles, repeated, "url", "left_anti", spread=["id", "updated_at"]).filter(F.col("url").isNotNull())
    again = lookup(articles, repeated, "url", "left_semi", spread=["id", "updated_at"]).unionByName(articles.filter(F.col("url").isNull()))
    best = again.groupBy(F.col("url").alias("_u")).agg(F.max_by(F.struct(*articles.columns), order).alias("_r")).select("_r.*")
    best = best.unionByName(alone.select(*best.columns))
    return best.filter(~fresh).unionByName(articles.filter(fresh))
