"""The domain dimension: profiles by page rank and imputed rows for new domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.urls import normalize_domain
from pressgrid.operators.lookup import lookup
from pressgrid.operators.ordering import assign_ids

# Scores given to a domain whose page rank has no usable profile.
DEFAULT_RANK = 3
DEFAULT_LLM, DEFAULT_HN, DEFAULT_SIGNAL, DEFAULT_TIER = 5, 0, 5, "Tier 3"
TIER_BOUNDS = (5, 7)


def derive_tier(page_rank: Column, bounds: tuple[int, int] = TIER_BOUNDS) -> Column:
    """Tier 3 below the first bound, Tier 2 below the second, else Tier 1."""
    return F.when(page_rank < bounds[0], "Tier 3").when(page_rank < bounds[1], "Tier 2") \
        .when(page_rank.isNotNull(), "Tier 1")


def signal_profile(media: DataFrame) -> DataFrame:
    """Per page rank the mean scores and the most common tier (smallest on a tie)."""
    per_tier = media.groupBy("page_rank", "tier").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{a}_{c}") for c in ("llm_rank", "hn_citation", "signal_score")
          for a, f in (("sum", F.sum), ("cnt", F.count))])

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(f"sum_{c}").cast("double"), F.sum(f"cnt_{c}"))

    common = F.min(F.struct((-F.col("n")).alias("n"), F.col("tier").alias("tier")))["tier"]
    return per_tier.groupBy("page_rank").agg(
        mean("llm_rank").alias("avg_llm"), mean("hn_citation").alias("avg_hn"),
        mean("signal_score").alias("avg_signal"), common.alias("common_tier"))


def impute_domains(new: DataFrame, media: DataFrame) -> DataFrame:
    """Scores for domains (domain, page_rank) the dimension lacks, from the profile of their rank."""
    wanted = (
        new.groupBy(normalize_domain(F.col("domain")).alias("domain")).agg(F.min("page_rank").alias("page_rank"))
        .filter(F.col("domain") != "")
        .withColumn("page_rank", F.coalesce("page_rank", F.lit(DEFAULT_RANK)).cast("long"))
    )
    known = media.select(normalize_domain(F.col("domain")).alias("domain")).distinct()
    missing = wanted.join(known, "domain", "left_anti")
    rated = lookup(missing, signal_profile(media), "page_rank")
    usable = F.coalesce(F.col("avg_llm") != 0, F.lit(False))

    def score(avg: str, fallback: int) -> Column:
        mean = F.when(F.col(avg) != 0, F.col(avg).cast("long"))
        return F.coalesce(F.when(usable, mean), F.lit(fallback)).cast("long")

    return rated.select(
        "domain", "page_rank", score("avg_llm", DEFAULT_LLM).alias("llm_rank"),
        score("avg_hn", DEFAULT_HN).alias("hn_citation"), score("avg_signal", DEFAULT_SIGNAL).alias("signal_score"),
        F.when(usable, F.coalesce("common_tier", F.lit(DEFAULT_TIER)))
        .otherwise(derive_tier(F.col("page_rank"))).alias("tier"))


def upsert_domains(new: DataFrame, media: DataFrame) -> DataFrame:
    """The dimension plus imputed rows for domains it lacks, numbered by domain."""
    added = assign_ids(impute_domains(new, media), media, F.col("domain"), by=["domain"])
    return media.unionByName(added, allowMissingColumns=True)
