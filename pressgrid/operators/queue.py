"""The work queue as an append-only log of status events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.urls import normalize_url
from pressgrid.operators.joins import known_keys
from pressgrid.operators.views import oldest

ERROR_LIMIT = 500


def latest_status(log: DataFrame, tie: str = "seq") -> DataFrame:
    """Current state per entry: the newest event, the later-numbered on a tie."""
    rest = [c for c in log.columns if c != "id"]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", tie))
    return log.groupBy("id").agg(newest.alias("_r")).select("id", "_r.*")


def next_pending(queue: DataFrame, n: int = 1, by: str = "updated_at") -> DataFrame:
    """First in, first out."""
    return oldest(queue.filter(F.col("status") == "pending"), n, by, "id").select("id", "url")


def intake(urls: DataFrame, articles: DataFrame, queue: DataFrame, own_site: str) -> DataFrame:
    """One row per normalised input URL: first position, number of copies and decision.

    own_site, duplicate (in the table or the queue) or added; further copies of an
    added URL count as duplicates. Every side of the joins holds each URL once.
    """
    wanted = urls.groupBy(normalize_url(F.col("url")).alias("url")).agg(
        F.min("pos").alias("pos"), F.count("*").alias("copies")).filter(F.col("url") != "")
    stored = articles.select("url").union(queue.select("url"))
    known = known_keys(stored, F.col("url"), wanted.select("url"), "url").withColumn("_known", F.lit(True))
    decision = F.when(F.lower("url").contains(own_site.lower()), "own_site") \
        .when(F.col("_known"), "duplicate").otherwise("added")
    return wanted.join(known, "url", "left").select("url", "pos", "copies", decision.alias("decision"))


def queue_add(
    urls: DataFrame, articles: DataFrame, queue: DataFrame, batch: str, as_of: Column, own_site: str,
) -> DataFrame:
    """New pending entries; the id follows from batch and URL, so a rerun yields the same."""
    return intake(urls, articles, queue, own_site).filter(F.col("decision") == "added").select(
        F.sha2(F.concat_ws("|", F.lit(batch), F.col("url")), 256).alias("id"), "url",
        F.lit("pending").alias("status"), F.lit(batch).alias("batch_name"), as_of.alias("created_at"),
        as_of.alias("updated_at"), F.lit(None).cast("string").alias("error_message"),
        F.lit(0).cast("long").alias("retry_count"))


def transition(entries: DataFrame, status: Column, as_of: Column, error: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Status events to append for these entries."""
    text = F.lit(None).cast("string") if error is None else F.substr(error, F.lit(1), F.lit(ERROR_LIMIT))
    out = entries.withColumns({"status": status, "updated_at": as_of, "error_message": text})
    return out if seq is None else out.withColumn("seq", seq)


def complete_batch(queue: DataFrame, batch: str, as_of: Column) -> DataFrame:
    """Pending entries of a batch become completed."""
    due = (F.col("batch_name") == batch) & (F.col("status") == "pending")
    return queue.withColumns({
        "status": F.when(due, "completed").otherwise(F.col("status")),
        "updated_at": F.when(due, as_of).otherwise(F.col("updated_at"))})


def override_pending(queue: DataFrame, batch: str, as_of: Column, message: str = "Manually marked complete") -> DataFrame:
    """The queue plus a completed copy of each pending entry of a batch."""
    copies = queue.filter((F.col("batch_name") == batch) & (F.col("status") == "pending")).withColumns({
        "id": F.concat("id", F.lit("_completed")), "status": F.lit("completed"), "updated_at": as_of,
        "error_message": F.lit(message)})
    return queue.unionByName(copies)
