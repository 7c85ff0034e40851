"""Streaming jobs run over the given tables until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrid.checks.match_queries import COUNTS, normal_articles
from pressgrid.checks.registry import check, load
from pressgrid.checks.table_queries import ENRICH_VIEWS, ENRICHED, ENRICHED_COLUMNS, NULLABLE, STATE, dictionaries
from pressgrid.checks.text_queries import norm_sql, processed
from pressgrid.checks.views import BRAND, FAMILY_ONE, FAMILY_TWO, stream_view, view
from pressgrid.session import new_dir
from pressgrid.streaming import jobs


def source(spark, d, table: str, name: str):
    return stream_view(spark, jobs.read_stream(spark, d, f"{table}.parquet"), table, name)


@check("stream_enrich", ENRICH_VIEWS, ENRICHED.replace("FROM tracked t)", "FROM tracked t WHERE data_ingestion AND id IS NOT NULL)")
       + f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM enriched", text=NULLABLE)
def _(spark, d):
    out = new_dir(spark, "enriched")
    articles = source(spark, d, "documents", "tracked").filter("id IS NOT NULL")
    jobs.enrich_query(
        articles, dictionaries(spark, d), BRAND, processed(), out, kill_pill=FAMILY_ONE, unwanted=FAMILY_TWO).awaitTermination()
    return jobs.stored(spark, out).select(*ENRICHED_COLUMNS)


@check("stream_dedupe", "submitted articles queue_log", f"""
, n AS (SELECT {norm_sql('url')} AS url, min(pos) AS pos FROM submitted GROUP BY 1)
SELECT url, pos FROM n WHERE url NOT IN (SELECT {norm_sql('url')} FROM articles) AND url NOT IN (SELECT url FROM queue_log)""")
def _(spark, d):
    out = new_dir(spark, "fresh")
    articles, log = load(spark, d, "articles", "queue_log")
    known = normal_articles(articles).select("url").unionByName(log.select("url"))
    jobs.dedupe_query(source(spark, d, "pages", "submitted"), known, out).awaitTermination()
    return jobs.stored(spark, out).select("url", "pos")


@check("stream_queue_state", "queue_log", STATE + "SELECT id, url, status, batch_name, updated_at FROM state", text="updated_at")
def _(spark, d):
    out = new_dir(spark, "state")
    jobs.queue_state_query(source(spark, d, "events", "queue_log"), out).awaitTermination()
    return jobs.queue_table(spark, out).read().drop("seq")


@check("stream_late_guard", "articles", """
SELECT date_trunc('hour', updated_at) AS hour_start, count(*) AS n FROM articles GROUP BY 1
HAVING date_trunc('hour', updated_at) + INTERVAL 1 HOUR <= (SELECT max(updated_at) FROM articles) - INTERVAL 90 MINUTE""", text="hour_start")
def _(spark, d):
    out = new_dir(spark, "settled")
    jobs.late_guard_query(source(spark, d, "documents", "articles"), out).awaitTermination()
    return jobs.settled_hours(spark, out)


ARRIVALS = 3
# The table arrives in three parts, by id; an hour is closed when the parts before say so.
ROUTED = f"""
, arrival AS (SELECT *, coalesce(id % {ARRIVALS}, 0) AS part, date_trunc('hour', updated_at) AS hour_start FROM articles)
, mark AS (SELECT p.part, max(updated_at) - INTERVAL 90 MINUTE AS closed FROM range({ARRIVALS}) AS p(part) LEFT JOIN arrival a ON a.part < p.part GROUP BY 1)
, routed AS (SELECT a.*, coalesce(hour_start + INTERVAL 1 HOUR <= closed, FALSE) AS late FROM arrival a JOIN mark USING (part))
"""


def _in_parts(spark, d) -> str:
    """The guard over a table that arrives in parts: one run of the job per part, as a poller would do it."""
    out = new_dir(spark, "guard")
    articles = view(spark, d, "articles").select("id", "url", "updated_at")
    for part in range(ARRIVALS):
        articles.filter(F.coalesce(F.col("id") % ARRIVALS, F.lit(0)) == part).write.mode("append").parquet(f"{out}/arrived")
        jobs.late_guard_query(jobs.read_stream(spark, f"{out}/arrived"), out).awaitTermination()
    return out


@check("stream_late_rows", "articles", ROUTED + "SELECT id, url, updated_at, part AS batch_id FROM routed WHERE late", text="id updated_at")
def _(spark, d):
    return jobs.late_rows(spark, _in_parts(spark, d)).select("id", "url", "updated_at", F.col("batch_id").cast("long").alias("batch_id"))


@check("stream_late_retry", "articles", ROUTED + """
SELECT hour_start, count(*) AS n FROM routed GROUP BY 1
HAVING hour_start + INTERVAL 1 HOUR <= (SELECT max(updated_at) FROM articles) - INTERVAL 90 MINUTE""", text="hour_start")
def _(spark, d):
    out = _in_parts(spark, d)
    jobs.retry_late(spark, out)
    return jobs.settled_hours(spark, out)


def _events(spark, d):
    return jobs.read_stream(spark, d, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@check("stream_activity", sql="""
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""", text="window_start")
def _(spark, d):
    view(spark, d, "events")
    out = new_dir(spark, "activity")
    jobs.activity_query(_events(spark, d), out, "event_type").awaitTermination()
    return jobs.newest_version(jobs.stored(spark, out), "window_start", "event_type")


@check("stream_activity_sliding", sql="""
WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events)
SELECT b - to_minutes(back) AS window_start, event_type, count(*) AS n FROM e, (VALUES (0), (30), (60), (90)) AS t(back) GROUP BY 1, 2""", text="window_start")
def _(spark, d):
    view(spark, d, "events")
    out = new_dir(spark, "activity")
    jobs.activity_query(_events(spark, d), out, "event_type", "2 hours", "30 minutes").awaitTermination()
    return jobs.newest_version(jobs.stored(spark, out), "window_start", "event_type")


@check("stream_share_counts", "mentions articles", COUNTS + "SELECT mention_url, id, shares FROM exact")
def _(spark, d):
    out = new_dir(spark, "shares")
    jobs.share_count_query(source(spark, d, "conversations", "mentions"), BRAND, out).awaitTermination()
    return jobs.article_shares(spark, out, view(spark, d, "articles"))


@check("stream_error_counts", "step_log", """
SELECT date_trunc('hour', ts) AS window_start, step, count(*) AS n FROM step_log WHERE severity = 'ERROR' GROUP BY 1, 2""", text="window_start")
def _(spark, d):
    out = new_dir(spark, "errors")
    jobs.error_count_query(source(spark, d, "events", "step_log"), out).awaitTermination()
    return jobs.newest_version(jobs.stored(spark, out), "window_start", "step")
