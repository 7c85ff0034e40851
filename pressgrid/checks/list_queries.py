"""Filters, top-k lists, paging and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrid.checks.registry import check, latest, load
from pressgrid.checks.views import view
from pressgrid.operators import monthly, quality, queue, search_index, views
from pressgrid.operators.ordering import batches
from pressgrid.schemas import REQUIRED_FIELDS, conform
from pressgrid.session import new_dir
from pressgrid.sources.tables import append_articles, swap_months

NOW = "(SELECT max(updated_at) FROM articles)"
NEWEST = "ORDER BY updated_at DESC NULLS LAST, url ASC NULLS FIRST"


def short(column: str, limit: int) -> str:
    return f"CASE WHEN length({column}) > {limit} THEN substr({column}, 1, {limit}) || '...' ELSE {column} END"


def short_or(column: str, limit: int, empty: str) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} = '' THEN '{empty}' ELSE {short(column, limit)} END"


@check("scan_articles", "articles", "SELECT id, url, social_shares_count FROM articles WHERE url IS NOT NULL", text="id")
def _(spark, d):
    return view(spark, d, "articles").filter("url IS NOT NULL").select("id", "url", "social_shares_count")


@check("recent_records", "tracked", f"""
SELECT id, updated_at, publish_date, url, domain, {short_or('title', 50, 'No title')} AS title, matched_spokespeople,
  matched_reporter, CASE WHEN tagged_brand THEN 'Yes' ELSE 'No' END AS tagged_brand, language
FROM tracked {NEWEST} LIMIT 25""", text="id updated_at publish_date")
def _(spark, d):
    return views.recent_records(view(spark, d, "tracked"), 25)


@check("tagging_status", "tracked", f"""
SELECT id, {short('url', 60)} AS url, {short('title', 40)} AS title,
  CASE WHEN tagged_brand THEN 'TRUE' ELSE 'FALSE' END AS tagged_brand,
  {short_or('matched_spokespeople', 30, 'None')} AS matched_spokespeople,
  {short_or('matched_portcos', 30, 'None')} AS matched_portcos
FROM (SELECT * FROM tracked {NEWEST} LIMIT 40)""", text="id")
def _(spark, d):
    return views.tagging_status(view(spark, d, "tracked"), 40)


@check("recent_logs", "step_log", f"""
SELECT substr(run_id, 1, 8) || '...' AS run_id, {short_or('url', 50, 'N/A')} AS url, step, severity,
  coalesce({short('context', 100)}, '') AS context, ts
FROM step_log ORDER BY ts DESC, seq LIMIT 20""", text="ts")
def _(spark, d):
    return views.recent_logs(view(spark, d, "step_log"), 20)


@check("step_errors", "step_log", f"""
SELECT substr(run_id, 1, 8) || '...' AS run_id, {short_or('url', 60, 'N/A')} AS url,
  CASE WHEN context IS NULL OR context = '' THEN 'No context' ELSE context END AS context, ts
FROM step_log WHERE step = 'NORMALIZE' AND severity = 'ERROR' ORDER BY ts DESC, seq LIMIT 10""", text="ts")
def _(spark, d):
    return views.step_errors(view(spark, d, "step_log"), "NORMALIZE", 10)


@check("needs_reprocessing", "tracked", f"""
SELECT url, {short_or('title', 40, 'No title')} AS title, domain, coalesce(CAST(id AS VARCHAR), 'Missing') AS id,
  CASE WHEN tagged_brand THEN 'yes' ELSE 'no' END AS tagged_brand,
  CASE WHEN language IS NULL OR language = '' THEN 'no' ELSE language END AS language,
  CASE WHEN tier IS NULL OR tier = '' THEN 'no' ELSE tier END AS tier,
  CASE WHEN kill_pill THEN 'yes' ELSE 'no' END AS kill_pill,
  CASE WHEN brand_in_headline THEN 'yes' ELSE 'no' END AS brand_in_headline,
  CASE WHEN coalesce(cleaned_url, '') <> '' THEN 'yes' ELSE 'no' END AS cleaned_url
FROM (SELECT * FROM tracked WHERE id IS NULL OR tagged_brand IS NULL OR language IS NULL OR tier IS NULL
  OR kill_pill IS NULL OR kill_pill_count IS NULL OR brand_in_headline IS NULL OR unwanted_count IS NULL
  OR cleaned_url IS NULL OR unwanted IS NULL OR language = '' OR tier = '' OR cleaned_url = ''
  {NEWEST} LIMIT 20)""")
def _(spark, d):
    return views.needs_reprocessing(view(spark, d, "tracked"), 20)


@check("unscraped", "articles", f"""
SELECT id, url, CASE WHEN title IS NULL OR title = '' THEN 'No title' ELSE title END AS title, domain
FROM (SELECT * FROM articles WHERE content IS NULL OR trim(content) = '' {NEWEST} LIMIT 500)""", text="id")
def _(spark, d):
    return views.unscraped(view(spark, d, "articles"), 500)


@check("missing_content_by_id", "articles", """
SELECT id, url FROM articles WHERE (content IS NULL OR content = '') AND url IS NOT NULL
ORDER BY id ASC NULLS FIRST, url LIMIT 50""", text="id")
def _(spark, d):
    return views.missing_content_by_id(view(spark, d, "articles"), 50)


@check("missing_or_placeholder", "articles", """
SELECT id, url, domain FROM articles WHERE content IS NULL OR trim(content) = '' OR content = 'needs enrichment'
ORDER BY id DESC NULLS LAST, url LIMIT 50""", text="id")
def _(spark, d):
    return views.missing_or_placeholder(view(spark, d, "articles"), 50)


@check("flawed_articles", "articles queue_log", """
SELECT id, url, coalesce(length(content), 0) AS content_length FROM articles
WHERE id BETWEEN 10 AND 100000000
  AND (content = 'needs enrichment' OR content IS NULL OR content = '' OR length(content) < 100)
  AND id NOT IN (SELECT CAST(id AS BIGINT) FROM queue_log WHERE status = 'failed')
ORDER BY id, url LIMIT 100""")
def _(spark, d):
    articles, log = load(spark, d, "articles", "queue_log")
    failed = log.filter("status = 'failed'").select(F.col("id").cast("long").alias("id"))
    return views.flawed_articles(articles, 10, 100_000_000, failed, 100)


@check("placeholder_brand", "articles", """
SELECT id, url FROM articles WHERE trim(content) = 'needs enrichment' ORDER BY id NULLS FIRST, url LIMIT 100""", text="id")
def _(spark, d):
    return views.placeholder_brand(view(spark, d, "articles"), "needs enrichment", 100)


@check("pending_text", "tracked", """
SELECT url, title, domain, publish_date FROM tracked WHERE text_scraped = FALSE
ORDER BY updated_at ASC NULLS FIRST, url LIMIT 50""", text="publish_date")
def _(spark, d):
    return views.pending_text(view(spark, d, "tracked"), 50)


@check("ingest_flagged", "articles", """
SELECT id, url, domain, (SELECT count(*) FROM articles WHERE data_ingestion) AS remaining
FROM articles WHERE data_ingestion ORDER BY id ASC NULLS FIRST, url LIMIT 50""", text="id")
def _(spark, d):
    return views.ingest_flagged(view(spark, d, "articles"), 50)


@check("recent_window", "articles", f"""
SELECT id, url, updated_at FROM articles WHERE updated_at >= {NOW} - INTERVAL 12 HOUR""", text="id updated_at")
def _(spark, d):
    articles = view(spark, d, "articles")
    return views.recent_window(articles, latest(articles), 12).select("id", "url", "updated_at")


@check("recent_activity", "articles", f"""
SELECT id, url, CASE WHEN title IS NULL OR title = '' THEN 'No title' ELSE title END AS title, domain, updated_at,
  CASE WHEN content IS NOT NULL AND length(content) > 0 THEN 'Full Scrape' ELSE 'Quick Scrape' END AS scrape_type
FROM articles WHERE updated_at IS NOT NULL {NEWEST} LIMIT 30""", text="id updated_at")
def _(spark, d):
    return views.recent_activity(view(spark, d, "articles"), 30)


STATE = """
, state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) AS rn FROM queue_log) WHERE rn = 1)
"""


@check("pending_queue", "queue_log", f"""{STATE}
SELECT id, url, status, updated_at, batch_name FROM (
  SELECT * FROM state WHERE status IN ('pending', 'processing') ORDER BY updated_at DESC, id LIMIT 100)
WHERE url NOT LIKE '%example.org/19%'""", text="updated_at")
def _(spark, d):
    return views.pending_queue(queue.latest_status(view(spark, d, "queue_log")), 100, hide="example.org/19")


@check("search_articles", "tracked", """
SELECT id, url, title, updated_at FROM tracked
WHERE CAST(id AS VARCHAR) LIKE '%that and%' OR url ILIKE '%that and%' OR title ILIKE '%that and%'
  OR matched_portcos ILIKE '%that and%' OR content ILIKE '%that and%'""", text="id updated_at")
def _(spark, d):
    return views.search_articles(view(spark, d, "tracked"), " That and ").select("id", "url", "title", "updated_at")


@check("search_stored", "tracked", """
SELECT id, url, title, updated_at FROM tracked
WHERE CAST(id AS VARCHAR) LIKE '%src7.e%/1_7%' OR url ILIKE '%src7.e%/1_7%' OR title ILIKE '%src7.e%/1_7%'
  OR matched_portcos ILIKE '%src7.e%/1_7%' OR content ILIKE '%src7.e%/1_7%'""", text="id updated_at")
def _(spark, d):
    path = new_dir(spark, "search")
    search_index.index_months(conform(view(spark, d, "tracked")), path, block_rows=500)
    return search_index.search_stored(spark, path, "SRC7.e%/1_7").select("id", "url", "title", "updated_at")


@check("point_lookup", "articles", """
SELECT id, url, title FROM articles WHERE url = 'https://src3.example.com/3' OR id = 17 OR id BETWEEN 40 AND 59""", text="id")
def _(spark, d):
    return views.point_lookup(
        view(spark, d, "articles"), "https://src3.example.com/3", 17, (40, 59)).select("id", "url", "title")


@check("false_entries", "articles", f"""
SELECT id, url, updated_at, 'null_id' AS reason FROM articles WHERE id IS NULL
UNION ALL SELECT id, url, updated_at, 'test_domain' FROM articles WHERE domain = 'src5.example.com'
UNION ALL SELECT id, url, updated_at, 'flagged_ingest' FROM articles WHERE data_ingestion
UNION ALL SELECT id, url, updated_at, 'recent' FROM articles WHERE updated_at >= {NOW} - INTERVAL 2 HOUR""", text="id updated_at")
def _(spark, d):
    articles = view(spark, d, "articles")
    return views.false_entries(articles, "src5.example.com", latest(articles))


@check("content_preview", "articles", f"""
SELECT url, title, domain, updated_at, length(coalesce(content, '')) AS content_length
FROM articles WHERE length(coalesce(content, '')) < 100 {NEWEST} LIMIT 10""", text="updated_at")
def _(spark, d):
    return views.content_preview(view(spark, d, "articles"), 10, below=100)


@check("sample_rows", "tracked", """
SELECT url, title, domain, publish_date FROM tracked WHERE text_scraped = FALSE OR content = '' OR content IS NULL
ORDER BY md5('seed-1' || coalesce(url, '')), url, updated_at LIMIT 1""", text="publish_date")
def _(spark, d):
    rows = view(spark, d, "tracked")
    due = (~F.col("text_scraped")) | (F.col("content") == "") | F.col("content").isNull()
    return views.sample_rows(rows, due, "url", "seed-1").select("url", "title", "domain", "publish_date")


@check("row_count", "articles", """
SELECT count(*) AS total, count(*) FILTER (WHERE data_ingestion) AS flagged,
  count(*) FILTER (WHERE content ILIKE '%that and%') AS found FROM articles""")
def _(spark, d):
    found = F.coalesce(F.col("content").ilike("%that and%"), F.lit(False))
    return view(spark, d, "articles").agg(
        F.count("*").alias("total"), F.count_if("data_ingestion").alias("flagged"), F.count_if(found).alias("found"))


def _filled(name: str, blank: bool) -> str:
    return f"({name} IS NOT NULL" + (f" AND {name} <> '')" if blank else ")")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE {_filled(n, b)}) AS has_{n}" for n, _, b in REQUIRED_FIELDS)
COMPLETE = " AND ".join(_filled(n, b) for n, _, b in REQUIRED_FIELDS)


def report_sql(table: str, extra: str = "") -> str:
    """The long completeness report of a view."""
    return "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS field, '{t}' AS type, count(*) FILTER (WHERE {_filled(n, b)}) AS filled, "
        f"count(*) - count(*) FILTER (WHERE {_filled(n, b)}) AS missing, "
        f"CAST(coalesce(round(count(*) FILTER (WHERE {_filled(n, b)}) * 100.0 / nullif(count(*), 0)), 0) AS BIGINT) AS percent{extra} "
        f"FROM {table}" for i, (n, t, b) in enumerate(REQUIRED_FIELDS, 1))


@check("completeness_counts", "tracked", f"SELECT count(*) AS total, {_COUNTS} FROM tracked")
def _(spark, d):
    return quality.completeness_counts(conform(view(spark, d, "tracked")))


@check("fully_complete", "tracked", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {COMPLETE}) AS fully_complete,
  count(*) FILTER (WHERE data_ingestion) AS pending_scrape FROM tracked""")
def _(spark, d):
    return quality.fully_complete(conform(view(spark, d, "tracked")))


@check("completeness_report", "tracked", report_sql("tracked"))
def _(spark, d):
    return quality.completeness_report(conform(view(spark, d, "tracked")))


MONTHLY = ", monthly AS (SELECT * REPLACE (CAST(date_trunc('month', publish_date) AS DATE) AS month) FROM tracked)\n"


def stored_months(spark, d) -> tuple[str, str]:
    """The articles stored by month of publication, and their partial results; one month is changed and counted anew."""
    path = new_dir(spark, "monthly")
    rows = conform(view(spark, d, "tracked").withColumn("month", F.trunc("publish_date", "month")))
    march = F.coalesce(F.col("month") == F.lit("2024-03-01").cast("date"), F.lit(False))
    append_articles(rows.withColumn("content", F.when(~march, F.col("content"))), path)
    monthly.refresh_months(spark, path, f"{path}-stats")
    swap_months(rows.filter(march), path)
    assert len(monthly.refresh_months(spark, path, f"{path}-stats")) <= 1
    return path, f"{path}-stats"


@check("stored_completeness_counts", "tracked", f"{MONTHLY}SELECT count(*) AS total, {_COUNTS} FROM monthly")
def _(spark, d):
    return monthly.stored_completeness_counts(spark, stored_months(spark, d)[1])


@check("stored_completeness_report", "tracked", MONTHLY + report_sql("monthly"))
def _(spark, d):
    return monthly.stored_completeness_report(spark, stored_months(spark, d)[1])


@check("stored_top_domains", "tracked", """
SELECT domain, count(*) AS articles FROM tracked WHERE domain IS NOT NULL GROUP BY domain ORDER BY 2 DESC, 1 LIMIT 100""")
def _(spark, d):
    return monthly.stored_top_domains(spark, stored_months(spark, d)[1], 100)


@check("mark_complete", "tracked", f"SELECT id, url, updated_at, ({COMPLETE}) AS is_complete FROM tracked", text="id updated_at")
def _(spark, d):
    return quality.mark_complete(conform(view(spark, d, "tracked"))).select("id", "url", "updated_at", "is_complete")


@check("top_domains", "articles", """
SELECT domain, count(*) AS articles FROM articles GROUP BY domain ORDER BY 2 DESC, 1 ASC NULLS FIRST LIMIT 10""")
def _(spark, d):
    return quality.top_domains(view(spark, d, "articles"))


@check("duplicate_urls", "articles", """
SELECT url, count(*) AS copies FROM articles GROUP BY url HAVING count(*) > 1 ORDER BY copies DESC, url LIMIT 50""")
def _(spark, d):
    return quality.duplicate_urls(view(spark, d, "articles"))


@check("input_duplicates", "submitted", """
, n AS (SELECT trim(url) AS url, count(*) AS copies FROM submitted GROUP BY 1)
SELECT url, copies, (SELECT CAST(sum(copies - 1) AS BIGINT) FROM n) AS surplus_rows FROM n WHERE copies > 1""")
def _(spark, d):
    return quality.input_duplicates(view(spark, d, "submitted").select(F.trim("url").alias("url")))


@check("queue_status", "queue_log", f"""{STATE}
SELECT batch_name, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed
FROM state GROUP BY batch_name""")
def _(spark, d):
    return quality.queue_status(queue.latest_status(view(spark, d, "queue_log")))


@check("status_counts", "queue_log", f"{STATE} SELECT status, count(*) AS n FROM state GROUP BY status")
def _(spark, d):
    return quality.status_counts(queue.latest_status(view(spark, d, "queue_log")))


@check("batch_progress", "queue_log", f"""{STATE}
, s AS (SELECT batch_name, count(*) AS total, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS processed,
    count(*) FILTER (WHERE status IN ('pending', 'processing')) AS open
  FROM state WHERE batch_name <> 'test_batch' GROUP BY batch_name)
SELECT batch_name, total, processed, round(CAST(processed AS DOUBLE) / total, 4) AS progress FROM s WHERE open > 0""")
def _(spark, d):
    return quality.batch_progress(queue.latest_status(view(spark, d, "queue_log")))


@check("content_buckets", "articles", """
SELECT count(*) AS total, count(*) FILTER (WHERE length(coalesce(content, '')) = 0) AS empty_content,
  count(*) FILTER (WHERE length(coalesce(content, '')) < 100) AS minimal_content,
  count(*) FILTER (WHERE length(coalesce(content, '')) >= 100) AS full_content FROM articles""")
def _(spark, d):
    return quality.content_buckets(view(spark, d, "articles"))


@check("max_id", "articles", "SELECT coalesce(max(id), 0) AS max_id FROM articles")
def _(spark, d):
    return quality.max_id(view(spark, d, "articles"))


@check("batch_outcome", "queue_log", f"""{STATE}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(error_message) AS errors,
  round(count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*), 1) AS success_rate FROM state""")
def _(spark, d):
    return quality.batch_outcome(queue.latest_status(view(spark, d, "queue_log")))


@check("verify_counts", "articles", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE id IS NULL) AS null_ids,
  count(*) FILTER (WHERE domain = 'src5.example.com') AS test_rows FROM articles""")
def _(spark, d):
    return quality.verify_counts(view(spark, d, "articles"), "src5.example.com")


@check("topk_recent", "articles", f"SELECT id, url, title, domain, updated_at FROM articles {NEWEST} LIMIT 10", text="id updated_at")
def _(spark, d):
    return views.newest(view(spark, d, "articles"), 10).select("id", "url", "title", "domain", "updated_at")


@check("page", "articles", f"""
, hits AS (SELECT * FROM articles WHERE title ILIKE '%the%' OR content ILIKE '%the%' OR url ILIKE '%the%' OR CAST(id AS VARCHAR) LIKE '%the%')
SELECT id, url, title, updated_at, (SELECT count(*) FROM hits) AS total,
  CAST(ceil((SELECT count(*) FROM hits) / 50.0) AS BIGINT) AS pages FROM hits {NEWEST} LIMIT 50 OFFSET 50""", text="id updated_at")
def _(spark, d):
    hits = views.search_articles(view(spark, d, "articles"), "the", ["url", "title", "content"])
    return views.page(hits.select("id", "url", "title", "updated_at"), 1)


@check("page_after", "articles", f"""
, ranked AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, url NULLS FIRST) AS n FROM articles)
SELECT id, url, title, updated_at FROM ranked
WHERE (updated_at, url) IN (SELECT (updated_at, url) FROM ranked WHERE n > 50 AND n <= 75)""", text="id updated_at")
def _(spark, d):
    articles = view(spark, d, "articles").select("id", "url", "title", "updated_at")
    last = views.page_after(articles, None, 50).collect()[-1]
    return views.page_after(articles, (last["updated_at"], last["url"]), 25)


@check("next_pending", "queue_log", f"""{STATE}
SELECT id, url FROM state WHERE status = 'pending' ORDER BY updated_at, id LIMIT 5""")
def _(spark, d):
    return queue.next_pending(queue.latest_status(view(spark, d, "queue_log")), 5)


@check("last_ids", "articles", "SELECT id, url FROM articles ORDER BY id DESC NULLS LAST, url LIMIT 18", text="id")
def _(spark, d):
    return view(spark, d, "articles").select("id", "url").orderBy(F.desc_nulls_last("id"), "url").limit(18)


@check("batches", "articles", """
SELECT url, updated_at, (row_number() OVER (ORDER BY updated_at, url) - 1) // 100 AS batch_no FROM articles""", text="updated_at")
def _(spark, d):
    rows = view(spark, d, "articles").select("url", "updated_at")
    return batches(rows, 100, F.asc("updated_at"), F.asc("url"), by=["updated_at", "url"])
