"""Stored partial results per month of a table: counts, heavy hitters, and where ids lie.

A month is counted anew only when its files have changed; reports merge what is
stored, so they cost the same however large the months are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.operators.quality import filled, is_complete, report_of
from pressgrid.schemas import ARTICLES, REQUIRED_FIELDS
from pressgrid.sources.folders import exists, fingerprints, remove
from pressgrid.sources.tables import swap_months

TRACKED = 10_000  # domains a month's sketch keeps at most
_SUMS = ["total", *(f"has_{n}" for n, _, _ in REQUIRED_FIELDS), "fully_complete", "pending_scrape", "no_domain"]


def refresh_months(spark: SparkSession, path: str, stats: str, tracked: int = TRACKED) -> list[str]:
    """Count the months of the stored table whose files have changed since; returns their names.

    `path`: a table partitioned by month; `stats`: where the partial results are kept, one row per month.
    """
    now = fingerprints(spark, path, "month")
    kept = {r["part"]: r["files"] for r in _stats(spark, stats).select("part", "files").collect()} if exists(spark, stats) else {}
    for gone in kept.keys() - now.keys():
        remove(spark, f"{stats}/part={gone}")
    changed = sorted(m for m in now if kept.get(m) != now[m])
    if changed:
        rows = read_months(spark, path, changed)
        marked = rows.withColumn("part", F.coalesce(F.date_format("month", "yyyy-MM-dd"), F.lit(NO_MONTH)))
        sums = [F.count("*").alias("total"), *(F.count_if(filled(n, b)).alias(f"has_{n}") for n, _, b in REQUIRED_FIELDS),
                F.count_if(is_complete()).alias("fully_complete"), F.count_if(F.col("data_ingestion")).alias("pending_scrape"),
                F.count_if(F.col("domain").isNull()).alias("no_domain"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
                F.expr(f"approx_top_k_accumulate(domain, {tracked}) FILTER (WHERE domain IS NOT NULL)").alias("domains")]
        files = F.create_map(*(F.lit(v) for m in changed for v in (m, now[m])))
        marked.groupBy("part").agg(*sums).withColumn("files", files[F.col("part")]).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(stats)
    return changed


NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def _stats(spark: SparkSession, stats: str) -> DataFrame:
    """The partial results; `part` is read as text, and rows without a month have their own."""
    rows = spark.read.option("mergeSchema", "false").parquet(stats)
    return rows.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit(NO_MONTH)))


def read_months(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """Only these months of a stored table."""
    return spark.read.schema(ARTICLES).option("basePath", path).parquet(*(f"{path}/month={m}" for m in months))


def stored_completeness_counts(spark: SparkSession, stats: str) -> DataFrame:
    """`completeness_counts` from the partial results."""
    return _stats(spark, stats).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS if c == "total" or c.startswith("has_")))


def stored_fully_complete(spark: SparkSession, stats: str) -> DataFrame:
    return _stats(spark, stats).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "fully_complete", "pending_scrape")))


def stored_completeness_report(spark: SparkSession, stats: str) -> DataFrame:
    return report_of(stored_completeness_counts(spark, stats))


def stored_top_domains(spark: SparkSession, stats: str, n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The n most frequent domains of all months by merged sketches (domain, articles).

    Counts are exact while no month has more than three quarters of `tracked` domains, and otherwise short or over by a bounded
    share of all rows (`error_share`); `quality.top_domains` is the exact form.
    """
    merged = _stats(spark, stats).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(domains, {tracked}), {min(n, tracked)})").alias("top"))
    return merged.select(F.explode("top").alias("t")).select(F.col("t.item").alias("domain"), F.col("t.count").alias("articles")) \
        .orderBy(F.desc("articles"), F.asc_nulls_first("domain"))


def error_share(tracked: int = TRACKED) -> float:
    """Largest error of a domain's count as a share of all rows: the sketch holds a power of two of counters, three quarters filled."""
    size = 1 << max(3, (tracked - 1).bit_length())
    return 3.5 / size


def months_of(spark: SparkSession, path: str, stats: str, ids: DataFrame) -> list[str]:
    """The months that hold any of the ids: those whose smallest and largest id embrace one, then by their id column alone."""
    wanted = ids.select(F.col("id").alias("_id")).filter("_id IS NOT NULL").distinct()
    ranges = _stats(spark, stats).select("part", "min_id", "max_id").collect()  # one row per month
    low = wanted.agg(F.min("_id").alias("a"), F.max("_id").alias("b")).first()
    near = [r["part"] for r in ranges if low["a"] is not None and r["min_id"] is not None and r["min_id"] <= low["b"] and r["max_id"] >= low["a"]]
    if not near:
        return []
    held = read_months(spark, path, near).select("id", "month").join(wanted, F.col("id") == F.col("_id"), "left_semi")
    found = held.select(F.coalesce(F.date_format("month", "yyyy-MM-dd"), F.lit(NO_MONTH)).alias("part")).distinct().collect()
    return sorted(r["part"] for r in found)


def change_rows(spark: SparkSession, path: str, stats: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Rewrites only the months that hold the ids, with `change` applied to their rows; returns these months.

    `change` may be any table-to-table update by id (`update_content`, `edit_rows`, `bulk_set`). Rows it moves to another month
    are put beside that month's own rows.
    """
    refresh_months(spark, path, stats)
    touched = months_of(spark, path, stats, ids)
    if not touched:
        return []
    part = F.coalesce(F.date_format("month", "yyyy-MM-dd"), F.lit(NO_MONTH))
    rows = change(read_months(spark, path, touched))
    after = {r[0] for r in rows.select(part.alias("part")).distinct().collect()}  # one per month
    others = sorted((after - set(touched)) & fingerprints(spark, path, "month").keys())
    if others:
        rows = rows.unionByName(read_months(spark, path, others))
    swap_months(rows, path)
    for emptied in set(touched) - after:
        remove(spark, f"{path}/month={emptied}")
    refresh_months(spark, path, stats)
    return sorted({*touched, *after})
