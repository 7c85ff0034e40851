"""The polling loops as Structured Streaming jobs.

Each `…_query` function starts a stream into a folder. Results are
written per micro-batch under `batch_id=N`, replacing that folder, so a repeated
batch leaves no double rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pressgrid.functions.urls import normalize_url
from pressgrid.operators.joins import known_keys
from pressgrid.operators.mentions import match_exact, mention_urls, relevant_mentions
from pressgrid.plans.enrich import Dictionaries, enrich_articles
from pressgrid.sources.folders import is_folder, numbered, remove
from pressgrid.streaming.folded import FoldedTable


def read_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive; the schema is that of the files present.

    A `pattern` that is the name of a folder stands for all files in it, as a table may be one file or a folder of files.
    """
    if is_folder(spark, f"{folder}/{pattern}"):
        folder, pattern = f"{folder}/{pattern}", "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def _per_batch(
    stream: DataFrame, out: str, work: Callable[[DataFrame, int], DataFrame], mode: str = "append",
    trigger: dict | None = None, reuse: bool = False,
) -> StreamingQuery:
    def store(batch: DataFrame, batch_id: int) -> None:
        if reuse:  # `work` reads the batch more than once
            batch = batch.persist()
        try:
            work(batch, batch_id).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
        finally:
            if reuse:
                batch.unpersist()

    writer = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{out}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, out: str) -> DataFrame:
    """All rows a job has written, with their batch_id."""
    return spark.read.parquet(f"{out}/rows")


def newest_version(rows: DataFrame, *key: str) -> DataFrame:
    """Update-mode output folded to the last state per key."""
    rest = [c for c in rows.columns if c not in key and c != "batch_id"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*key, "_r.*")


def enrich_query(
    articles: DataFrame, dictionaries: Dictionaries, brand: str, as_of: Column, out: str, trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Flagged articles through the batch enrichment (ids are given at intake)."""
    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        return enrich_articles(batch, dictionaries, brand, as_of, assign_missing_ids=False, **options)

    return _per_batch(articles.filter("data_ingestion"), out, work, trigger=trigger)


def _first_copies(rows: DataFrame, key: str, pos: str, whole: bool) -> DataFrame:
    """The copy with the smallest position of each key: per Arrow batch, or with `whole` per partition.

    Streams know no aggregation that starts anew with every batch, so copies are folded inside the tasks.
    """
    def first(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending"), (pos, "ascending")]))
        keys = table.column(key).combine_chunks()
        fresh = pa.concat_arrays([pa.array([True]), pc.not_equal(keys[1:], keys[:-1])]) if len(keys) else pa.array([], pa.bool_())
        return table.filter(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            kept.append(first(pa.Table.from_batches([batch])))
            if not whole:
                yield from kept.pop().to_batches()
            elif len(kept) > 1 and kept[-1].num_rows + sum(t.num_rows for t in kept[1:-1]) >= kept[0].num_rows:
                kept = [first(pa.concat_tables(kept))]  # each time twice as many rows, so the work stays in proportion
        if kept:
            yield from first(pa.concat_tables(kept)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def dedupe_query(
    urls: DataFrame, known: DataFrame | Callable[[], DataFrame], out: str, pos: str = "pos", horizon: str = "7 days",
    arrived: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """First sighting of each normalised URL that is neither known nor seen in an earlier batch.

    Spark's keyed state remembers the URLs seen, and lets them go when `horizon` has passed since
    they arrived (by the clock, or by the time column `arrived`); by then they have to be in `known`, which is
    read anew for each batch when it is a function. Earlier output is never read. Copies inside
    a batch are folded before they are shuffled and again before they meet the state, so a URL
    that fills a third of a batch is one row per Arrow batch, and the smallest position wins.
    """
    normal = urls.withColumn("url", normalize_url(F.col("url"))).filter(F.col("url") != "")
    folded = _first_copies(_first_copies(normal, "url", pos, whole=False).repartition("url"), "url", pos, whole=True)
    timed = folded.withColumn("_arrived", F.col(arrived) if arrived else F.current_timestamp())
    unseen = timed.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["url"]).drop("_arrived")

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        stored = known() if callable(known) else known
        # only the batch's own URLs are looked for, so the known ones are scanned, not shuffled
        return batch.join(known_keys(stored.select("url"), F.col("url"), batch.select("url"), "url"), "url", "left_anti")

    return _per_batch(unseen, out, work, trigger=trigger, reuse=True)


def _into_table(stream: DataFrame, table: FoldedTable, out: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(table.add).outputMode("append").option("checkpointLocation", f"{out}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def queue_table(spark: SparkSession, out: str, **sizes: int) -> FoldedTable:
    """The newest event per queue entry."""
    def newest(events: DataFrame) -> DataFrame:
        return events.groupBy("id").agg(F.max_by(
            F.struct("url", "status", "batch_name", "updated_at", "seq"), F.struct("updated_at", "seq")).alias("_r")).select("id", "_r.*")

    return FoldedTable(spark, f"{out}/table", "id", newest, **sizes)


def queue_state_query(log: DataFrame, out: str, trigger: dict | None = None, **sizes: int) -> StreamingQuery:
    """Current status per queue entry, kept as a snapshot and the batches since; `queue_table(spark, out).read()` shows it."""
    return _into_table(log, queue_table(log.sparkSession, out, **sizes), out, trigger)


def settled_query(rows: DataFrame, out: str, ts: str = "updated_at", delay: str = "90 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Hourly row counts, written only once no row of the hour can arrive any more; later rows are left out (`late_guard_query` keeps them)."""
    hours = rows.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n"))
    flat = hours.select(F.col("w.start").alias("hour_start"), "n")
    return _per_batch(flat, out, lambda batch, _: batch, "append", trigger)


def late_guard_query(
    rows: DataFrame, out: str, ts: str = "updated_at", delay: str = "90 minutes", trigger: dict | None = None,
) -> StreamingQuery:
    """Routes each row to its hour's count or, when that hour is closed, to the late table.

    An hour is closed once it ended more than `delay` before the newest row of the
    batches before. Its count is then written (`settled_hours`); rows that come later, and rows
    without a time, are kept whole (`late_rows`) until `retry_late` takes them up. Between batches only
    the counts of open hours and the newest time are kept, and a batch reads those of the batch before it, so a
    repeated batch decides alike.
    """
    spark = rows.sparkSession
    hour = F.date_trunc("hour", F.col(ts))
    margin = F.expr(f"INTERVAL {delay}")
    hour_end = F.col("hour_start") + F.expr("INTERVAL 1 HOUR")

    def work(batch: DataFrame, batch_id: int) -> DataFrame:
        before = batch_id - 1
        newest, open_hours = None, None
        if batch_id > 0:
            newest = spark.read.parquet(f"{out}/newest/batch_id={before}").first()["newest"]
            open_hours = spark.read.parquet(f"{out}/open/batch_id={before}")
        placed = batch.withColumn("hour_start", hour)
        closed = F.lit(False) if newest is None else hour_end <= F.lit(newest) - margin
        late = F.col("hour_start").isNull() | closed
        placed.filter(late).drop("hour_start").write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        counts = placed.filter(~late).groupBy("hour_start").agg(F.count("*").alias("n"))
        if open_hours is not None:
            counts = counts.unionByName(open_hours).groupBy("hour_start").agg(F.sum("n").alias("n"))
        top = batch.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest"))
        top.write.mode("overwrite").parquet(f"{out}/newest/batch_id={batch_id}")
        now = spark.read.parquet(f"{out}/newest/batch_id={batch_id}").first()["newest"]
        done = F.coalesce(hour_end <= F.lit(now).cast("timestamp") - margin, F.lit(False))
        counts.filter(~done).write.mode("overwrite").parquet(f"{out}/open/batch_id={batch_id}")
        for name in ("open", "newest"):
            remove(spark, f"{out}/{name}/batch_id={batch_id - 2}")
        return counts.filter(done)

    return _per_batch(rows, out, work, trigger=trigger, reuse=True)


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came when their hour was closed, and rows without a time, with the batch that brought them."""
    return spark.read.parquet(f"{out}/late")


def retry_late(spark: SparkSession, out: str, ts: str = "updated_at") -> int:
    """Counts late rows that no earlier retry took up; returns how many there were. A repeated retry adds nothing."""
    done = max(numbered(spark, f"{out}/retried", "upto"), default=-1)
    todo = [n for n in numbered(spark, f"{out}/late", "batch_id") if n > done]
    if not todo:
        return 0
    rows = spark.read.parquet(*(f"{out}/late/batch_id={n}" for n in todo)).filter(F.col(ts).isNotNull())
    counts = rows.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour_start")).agg(F.count("*").alias("n"))
    path = f"{out}/retried/upto={todo[-1]}"
    counts.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def settled_hours(spark: SparkSession, out: str) -> DataFrame:
    """Counts of closed hours, with the late rows that were retried."""
    rows = stored(spark, out).select("hour_start", "n")
    if numbered(spark, f"{out}/retried", "upto"):
        rows = rows.unionByName(spark.read.parquet(f"{out}/retried").select("hour_start", "n"))
    return rows.groupBy("hour_start").agg(F.sum("n").alias("n"))


def activity_query(
    events: DataFrame, out: str, kind: str, width: str = "1 hour", slide: str | None = None, ts: str = "ts",
    delay: str = "2 hours", trigger: dict | None = None,
) -> StreamingQuery:
    """Counts per time window and kind; tumbling, or sliding with `slide`."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = events.withWatermark(ts, delay).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"))
    flat = counts.select(F.col("w.start").alias("window_start"), kind, "n")
    return _per_batch(flat, out, lambda batch, _: batch, "update", trigger)


def share_table(spark: SparkSession, out: str, **sizes: int) -> FoldedTable:
    """Mentions per URL."""
    return FoldedTable(spark, f"{out}/table", "mention_url", lambda rows: rows.groupBy("mention_url").agg(F.sum("shares").alias("shares")), **sizes)


def share_count_query(mentions: DataFrame, brand: str, out: str, trigger: dict | None = None, **sizes: int) -> StreamingQuery:
    """Running mention counts per URL: each batch adds its own counts, nothing earlier is read for it."""
    urls = mention_urls(relevant_mentions(mentions, brand)).select("mention_url", F.lit(1).cast("long").alias("shares"))
    return _into_table(urls, share_table(mentions.sparkSession, out, **sizes), out, trigger)


def article_shares(spark: SparkSession, out: str, articles: DataFrame) -> DataFrame:
    """The running counts of the URLs that are an article's."""
    return match_exact(share_table(spark, out).read(), articles).select("mention_url", "id", "shares")


def error_count_query(
    log: DataFrame, out: str, width: str = "1 hour", delay: str = "2 hours", trigger: dict | None = None,
) -> StreamingQuery:
    """Errors per step and time window."""
    return activity_query(log.filter(F.col("severity") == "ERROR"), out, "step", width, delay=delay, trigger=trigger)
