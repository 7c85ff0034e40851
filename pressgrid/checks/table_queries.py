"""De-duplication, numbering, table transforms, queue changes, files and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrid import schemas
from pressgrid.checks.list_queries import STATE, report_sql
from pressgrid.checks.match_queries import INTAKE, MATCHES, found_sql, listed, normal_articles
from pressgrid.checks.registry import check, latest, load
from pressgrid.checks.text_queries import (
    BODY_SQL, PROCESSED, TITLE_SQL, clean_sql, family_sql, host_sql,
    keep_scheme_sql, known_domain_sql, norm_sql, processed, snippet_sql, word_sql,
)
from pressgrid.checks.views import BRAND, FAMILY_ONE, FAMILY_TWO, OWN_SITE, view
from pressgrid.operators import dedupe, monthly, ordering, queue, transforms
from pressgrid.operators.audit import run_summary
from pressgrid.plans import enrich, intake
from pressgrid.schemas import conform
from pressgrid.session import new_dir
from pressgrid.sources import files, tables

AS_OF = "TIMESTAMP '2025-01-31 00:00:00'"

# ---- repeated rows and numbering

SCORE = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in dedupe.SCORED)
RANKED = f"""
, ranked AS (SELECT *, {SCORE} AS filled_columns, count(*) OVER (PARTITION BY url) AS url_count,
    row_number() OVER (PARTITION BY url ORDER BY {SCORE} DESC, updated_at DESC NULLS LAST, id NULLS FIRST) AS rank FROM tracked)
"""


@check("rank_duplicates", "tracked", RANKED + """
SELECT id, url, updated_at, filled_columns, url_count, rank FROM ranked WHERE url_count > 1""", text="id updated_at")
def _(spark, d):
    return dedupe.rank_duplicates(view(spark, d, "tracked"))


@check("dedupe_keep_best", "tracked", RANKED + """
SELECT id, url, title, updated_at FROM ranked
WHERE rank = 1 OR updated_at > (SELECT max(updated_at) FROM tracked) - INTERVAL 90 MINUTE""", text="id updated_at")
def _(spark, d):
    rows = view(spark, d, "tracked")
    return dedupe.dedupe_keep_best(rows, latest(rows)).select("id", "url", "title", "updated_at")


@check("assign_ids", "submitted articles", """
SELECT pos, url, (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY pos) AS id FROM submitted""")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    return ordering.assign_ids(submitted, articles, F.col("pos"), by=["pos"])


@check("fill_missing_ids", "articles", """
SELECT id, url, updated_at FROM articles WHERE id IS NOT NULL
UNION ALL SELECT (SELECT max(id) FROM articles) + row_number() OVER (ORDER BY updated_at, url), url, updated_at FROM articles WHERE id IS NULL""", text="updated_at")
def _(spark, d):
    return ordering.fill_missing_ids(view(spark, d, "articles").select("id", "url", "updated_at"))


@check("stagger_timestamps", "submitted", f"""
SELECT pos, url, {AS_OF} + to_seconds(CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT)) AS updated_at FROM submitted""", text="updated_at")
def _(spark, d):
    return ordering.stagger_timestamps(view(spark, d, "submitted"), processed(), F.col("pos"), by=["pos"])


@check("latest_per_url", "articles", """
SELECT key, id, title, updated_at FROM (SELECT lower(trim(url)) AS key, *, row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY updated_at DESC) AS rn
  FROM articles WHERE trim(url) <> '') WHERE rn = 1""", text="id updated_at")
def _(spark, d):
    rows = view(spark, d, "articles").filter(F.trim("url") != "")
    return ordering.latest_by(rows, F.lower(F.trim("url")), F.col("updated_at"), "id", "title", "updated_at")


@check("latest_status", "queue_log", STATE + "SELECT id, url, status, batch_name, updated_at, error_message FROM state", text="updated_at")
def _(spark, d):
    return queue.latest_status(view(spark, d, "queue_log")).drop("seq")


# ---- inserts, updates, deletes


@check("insert_if_absent", "submitted articles", f"""
, base AS (SELECT id, {norm_sql('url')} AS url, updated_at, data_ingestion FROM articles)
, n AS (SELECT url, min(pos) AS pos FROM (SELECT pos, {norm_sql('url')} AS url FROM submitted) GROUP BY 1)
SELECT * FROM base
UNION ALL SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY pos), url, {AS_OF}, TRUE FROM n
  WHERE url NOT IN (SELECT url FROM base)""", text="id updated_at")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    base = normal_articles(articles).select("id", "url", "updated_at", "data_ingestion")
    return transforms.insert_if_absent(submitted, base, processed())


@check("prepare_record", "bodies", f"""
SELECT '' AS url, content, domain, title, '' AS matched_spokespeople, '' AS matched_reporter, '' AS matched_portcos,
  '' AS matched_vc_investors, '' AS matched_vehicle, '' AS managed_by_fund, '' AS country, '' AS language, '' AS kill_pill_context,
  '' AS unwanted_context, publish_date, {AS_OF} AS updated_at, FALSE AS tagged_brand, FALSE AS tagged_portco, FALSE AS unbranded_win,
  FALSE AS kill_pill, FALSE AS unwanted, CAST(0 AS BIGINT) AS kill_pill_count, CAST(0 AS BIGINT) AS unwanted_count FROM bodies""", text="updated_at")
def _(spark, d):
    return transforms.prepare_record(view(spark, d, "bodies").drop("id"), processed())


MONTH = f"CAST(date_trunc('month', coalesce(publish_date, CAST({AS_OF} AS DATE))) AS DATE)"
_EMPTY = ["title", "domain", "country", "content", "matched_spokespeople", "matched_vc_investors", "matched_reporter",
          "matched_portcos", "language", "managed_by_fund", "tier", "kill_pill_context", "unwanted_context", "matched_vehicle"]
_FALSE = ["tagged_brand", "kill_pill", "unwanted", "brand_in_headline", "tagged_portco", "unbranded_win", "text_scraped",
          "data_ingestion"]
_ZERO = ["page_rank", "kill_pill_count", "unwanted_count", "social_shares_count"]
_MISSING_EMPTY = ["matched_dealroom_rank", "matched_portco_location", "matched_portco_deal_lead", "summary", "li_summary",
                  "text_scrape_error"]
FILLED_LIST = ", ".join(
    ["id", "url", "updated_at"] + [f"coalesce({c}, '') AS {c}" for c in _EMPTY]
    + [f"coalesce({c}, FALSE) AS {c}" for c in _FALSE] + [f"coalesce({c}, 0) AS {c}" for c in _ZERO]
    + [f"'' AS {c}" for c in _MISSING_EMPTY] + ["FALSE AS is_complete", "FALSE AS spokespeople_in_headline"]
    + [f"coalesce(month, {MONTH}) AS month", f"coalesce(cleaned_url, {keep_scheme_sql('url')}) AS cleaned_url",
       "CAST(0 AS DOUBLE) AS backlinks"]
    + [f"TIMESTAMP '1970-01-01 00:00:00' AS {c}" for c in ("text_scraped_at", "ingestion_date", "scrape_date")])
FILLED_COLUMNS = (["id", "url", "updated_at"] + _EMPTY + _FALSE + _ZERO + _MISSING_EMPTY
                  + ["is_complete", "spokespeople_in_headline", "month", "cleaned_url", "backlinks", "text_scraped_at",
                     "ingestion_date", "scrape_date"])
TIMES = "id updated_at month text_scraped_at ingestion_date scrape_date"


@check("fill_defaults", "tracked", f"SELECT {FILLED_LIST} FROM tracked", text=TIMES)
def _(spark, d):
    return transforms.fill_defaults(conform(view(spark, d, "tracked")), processed()).select(*FILLED_COLUMNS)


@check("fill_defaults_where_needed", "tracked", f"""
, due AS (SELECT *, (country IS NULL OR tier IS NULL OR language IS NULL OR kill_pill IS NULL OR month IS NULL
  OR matched_portcos IS NULL OR matched_vehicle IS NULL) AS d FROM tracked)
SELECT updated_at, CASE WHEN d THEN coalesce(title, '') ELSE title END AS title, CASE WHEN d THEN coalesce(country, '') ELSE country END AS country,
  CASE WHEN d THEN coalesce(tagged_brand, FALSE) ELSE tagged_brand END AS tagged_brand,
  CASE WHEN d THEN coalesce(month, {MONTH}) ELSE month END AS month FROM due""", text="updated_at month tagged_brand")
def _(spark, d):
    filled = transforms.fill_defaults(conform(view(spark, d, "tracked")), processed(), transforms.needs_fill())
    return filled.select("updated_at", "title", "country", "tagged_brand", "month")


@check("fill_language", "articles", """
SELECT updated_at, CASE WHEN language = '' AND content <> '' THEN 'en' ELSE language END AS language FROM articles""", text="updated_at")
def _(spark, d):
    return transforms.fill_language(view(spark, d, "articles")).select("updated_at", "language")


@check("flag_brand_headline", "tracked", """
SELECT updated_at, CASE WHEN title <> '' THEN contains(lower(title), 'hat') ELSE brand_in_headline END AS brand_in_headline FROM tracked""", text="updated_at brand_in_headline")
def _(spark, d):
    return transforms.flag_brand_headline(view(spark, d, "tracked"), "hat").select("updated_at", "brand_in_headline")


_JOIN_BODIES = "FROM tracked t LEFT JOIN bodies b ON t.id = b.id"


@check("update_content", "tracked bodies", f"""
SELECT t.id, t.url, CASE WHEN b.id IS NOT NULL THEN b.content ELSE t.content END AS content,
  CASE WHEN b.id IS NOT NULL THEN coalesce(nullif(t.title, ''), b.title) ELSE t.title END AS title,
  CASE WHEN b.id IS NOT NULL THEN coalesce(t.publish_date, CAST(try_strptime(b.publish_date, '%Y-%m-%d') AS DATE)) ELSE t.publish_date END AS publish_date,
  CASE WHEN b.id IS NOT NULL THEN FALSE ELSE t.data_ingestion END AS data_ingestion, t.updated_at {_JOIN_BODIES}""", text="id publish_date updated_at")
def _(spark, d):
    rows, bodies = load(spark, d, "tracked", "bodies")
    done = transforms.update_content(conform(rows), bodies, processed())
    return done.select("id", "url", "content", "title", "publish_date", "data_ingestion", "updated_at")


@check("update_content_new_title", "tracked bodies", f"""
SELECT t.id, t.url, CASE WHEN b.id IS NOT NULL THEN b.content ELSE t.content END AS content,
  CASE WHEN b.id IS NOT NULL THEN coalesce(nullif(b.title, ''), t.title) ELSE t.title END AS title {_JOIN_BODIES}""", text="id")
def _(spark, d):
    rows, bodies = load(spark, d, "tracked", "bodies")
    return transforms.update_content(rows, bodies, processed(), "new").select("id", "url", "content", "title")


@check("update_content_overwrite", "tracked bodies", f"""
SELECT t.id, t.url, CASE WHEN b.id IS NOT NULL THEN b.content ELSE t.content END AS content,
  CASE WHEN b.id IS NOT NULL THEN b.title ELSE t.title END AS title,
  CASE WHEN b.id IS NOT NULL THEN b.domain ELSE t.domain END AS domain {_JOIN_BODIES}""", text="id")
def _(spark, d):
    rows, bodies = load(spark, d, "tracked", "bodies")
    return transforms.update_content(rows, bodies, processed(), "overwrite").select("id", "url", "content", "title", "domain")


@check("apply_scrape_result", "tracked bodies", f"""
, r AS (SELECT 'https://src' || CAST(id % 20 AS VARCHAR) || '.example.com/' || CAST(id AS VARCHAR) AS url,
    CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 2 THEN 'too short' ELSE content END AS content, CASE WHEN id % 12 = 0 THEN content || content END AS error FROM bodies)
SELECT t.id, t.url, CASE WHEN length(trim(r.content)) > 50 THEN r.content ELSE t.content END AS content,
  CASE WHEN length(trim(r.content)) > 50 THEN TRUE WHEN r.url IS NULL THEN t.text_scraped ELSE coalesce(t.text_scraped, FALSE) END AS text_scraped,
  CASE WHEN length(trim(r.content)) > 50 THEN {AS_OF} END AS text_scraped_at,
  CASE WHEN r.url IS NULL OR length(trim(r.content)) > 50 THEN NULL ELSE substr(coalesce(r.error, 'Content extraction failed'), 1, 500) END AS text_scrape_error,
  CASE WHEN r.url IS NULL THEN t.updated_at ELSE {AS_OF} END AS updated_at
FROM tracked t LEFT JOIN r ON t.url = r.url""", text="id text_scraped text_scraped_at updated_at")
def _(spark, d):
    rows, bodies = load(spark, d, "tracked", "bodies")
    i = F.col("id")
    results = bodies.select(
        F.concat(F.lit("https://src"), i % 20, F.lit(".example.com/"), i).alias("url"),
        F.when(i % 6 == 0, None).when(i % 6 == 2, "too short").otherwise(F.col("content")).alias("content"),
        F.when(i % 12 == 0, F.concat("content", "content")).alias("error"))
    done = transforms.apply_scrape_result(conform(rows), results, processed())
    return done.select("id", "url", "content", "text_scraped", "text_scraped_at", "text_scrape_error", "updated_at")


@check("edit_rows", "tracked", f"""
, e AS (SELECT id, CASE WHEN id % 2 = 0 THEN matched_portcos ELSE 'edited' END AS p, matched_spokespeople AS s, content AS c FROM tracked WHERE id % 3 = 0)
SELECT t.id, t.url, CASE WHEN e.id IS NOT NULL THEN p ELSE matched_portcos END AS matched_portcos,
  CASE WHEN e.id IS NOT NULL AND p IS DISTINCT FROM matched_portcos THEN {AS_OF} ELSE updated_at END AS updated_at
FROM tracked t LEFT JOIN e ON t.id = e.id""", text="id updated_at")
def _(spark, d):
    rows = view(spark, d, "tracked")
    edited = F.when(F.col("id") % 2 == 0, F.col("matched_portcos")).otherwise("edited")
    edits = rows.filter(F.col("id") % 3 == 0).withColumn("matched_portcos", edited)
    return transforms.edit_rows(rows, edits, processed()).select("id", "url", "matched_portcos", "updated_at")


@check("change_stored_rows", "tracked", f"""
, e AS (SELECT id, CASE WHEN id % 2 = 0 THEN matched_portcos ELSE 'edited' END AS p FROM tracked WHERE id % 3 = 0 AND publish_date >= DATE '2024-06-01')
SELECT t.id, t.url, CASE WHEN e.id IS NOT NULL THEN p ELSE matched_portcos END AS matched_portcos,
  CASE WHEN e.id IS NOT NULL AND p IS DISTINCT FROM matched_portcos THEN {AS_OF} ELSE updated_at END AS updated_at
FROM tracked t LEFT JOIN e ON t.id = e.id""", text="id updated_at")
def _(spark, d):
    path = new_dir(spark, "monthly")
    rows = conform(view(spark, d, "tracked").withColumn("month", F.trunc("publish_date", "month")))
    tables.append_articles(rows, path)
    edited = F.when(F.col("id") % 2 == 0, F.col("matched_portcos")).otherwise("edited")
    edits = rows.filter((F.col("id") % 3 == 0) & (F.col("publish_date") >= "2024-06-01")).withColumn("matched_portcos", edited)
    monthly.change_rows(spark, path, f"{path}-stats", edits, lambda part: transforms.edit_rows(part, edits, processed()))
    return spark.read.schema(schemas.ARTICLES).parquet(path).select("id", "url", "matched_portcos", "updated_at")


@check("bulk_set", "tracked bodies", """
SELECT id, url, CASE WHEN id IN (SELECT id FROM bodies) THEN 'New Person' ELSE matched_spokespeople END AS matched_spokespeople FROM tracked""", text="id")
def _(spark, d):
    rows, bodies = load(spark, d, "tracked", "bodies")
    return transforms.bulk_set(rows, bodies, "matched_spokespeople", "New Person").select("id", "url", "matched_spokespeople")


_DOOMED = f"(SELECT {norm_sql('url')} FROM submitted WHERE url IS NOT NULL)"


@check("delete_by_url", "submitted articles", f"SELECT id, url FROM articles WHERE url NOT IN {_DOOMED}", text="id")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    return transforms.delete_by_url(articles.select("id", "url"), submitted)


@check("count_deleted", "submitted articles", f"SELECT count(*) AS deleted FROM articles WHERE url IN {_DOOMED}")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    return transforms.count_deleted(articles, submitted)


_PATTERNS = """
, p AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'https://src' || CAST(page_id % 20 AS VARCHAR) || '.example.com/' || CAST(page_id AS VARCHAR) || '...'
    ELSE 'https://...src' || CAST(page_id % 10 AS VARCHAR) || '.example.com/' || CAST(page_id AS VARCHAR) || '_...' END AS url FROM pages)
"""


@check("delete_by_pattern", "articles", _PATTERNS + """
SELECT id, url FROM articles a WHERE NOT EXISTS (SELECT 1 FROM p WHERE a.url LIKE replace(p.url, '...', '%'))""", text="id")
def _(spark, d):
    articles, pages = load(spark, d, "articles", "pages")
    i = F.col("page_id")
    patterns = pages.select(
        F.when(i % 2 == 0, F.concat(F.lit("https://src"), i % 20, F.lit(".example.com/"), i, F.lit("...")))
        .otherwise(F.concat(F.lit("https://...src"), i % 10, F.lit(".example.com/"), i, F.lit("_..."))).alias("url")).distinct()
    return transforms.delete_by_pattern(articles.select("id", "url"), patterns)


@check("delete_null_ids", "articles", "SELECT id, url FROM articles WHERE id IS NOT NULL")
def _(spark, d):
    return transforms.delete_null_ids(view(spark, d, "articles").select("id", "url"))


@check("delete_false_entries", "articles", """
SELECT id, url, domain FROM articles WHERE NOT coalesce(id IS NULL OR id BETWEEN 100 AND 150 OR domain = 'src5.example.com', FALSE)""")
def _(spark, d):
    return transforms.delete_false_entries(view(spark, d, "articles").select("id", "url", "domain"), 100, 150, "src5.example.com")


# ---- the queue


@check("queue_add", "submitted articles queue_log", INTAKE + f"""
SELECT sha256('b1|' || url) AS id, url, 'pending' AS status, 'b1' AS batch_name, {AS_OF} AS created_at, {AS_OF} AS updated_at,
  CAST(NULL AS VARCHAR) AS error_message, CAST(0 AS BIGINT) AS retry_count FROM intake WHERE decision = 'added'""", text="created_at updated_at")
def _(spark, d):
    submitted, articles, log = load(spark, d, "submitted", "articles", "queue_log")
    return queue.queue_add(submitted, normal_articles(articles), log, "b1", processed(), OWN_SITE)


@check("queue_transition", "queue_log", STATE + f"""
, done AS (SELECT id, CASE WHEN seq % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN seq % 3 = 0 THEN 'Metadata extraction failed' END AS error_message
  FROM state WHERE status = 'pending')
SELECT s.id, s.url, s.batch_name, coalesce(d.status, s.status) AS status, CASE WHEN d.id IS NOT NULL THEN d.error_message ELSE s.error_message END AS error_message
FROM state s LEFT JOIN done d ON s.id = d.id""")
def _(spark, d):
    log = view(spark, d, "queue_log")
    pending = queue.latest_status(log).filter("status = 'pending'").select(*log.columns)
    failed = F.col("seq") % 3 == 0
    later = F.col("seq") + 1_000_000_000
    started = queue.transition(pending, F.lit("processing"), processed(), seq=later)
    ended = queue.transition(
        pending, F.when(failed, "failed").otherwise("completed"), processed() + F.expr("INTERVAL 1 MINUTE"),
        F.when(failed, "Metadata extraction failed"), seq=later + 1)
    state = queue.latest_status(log.unionByName(started).unionByName(ended))
    return state.select("id", "url", "batch_name", "status", "error_message")


@check("complete_batch", "queue_log", STATE + f"""
SELECT id, batch_name, CASE WHEN batch_name = 'test_batch' AND status = 'pending' THEN 'completed' ELSE status END AS status,
  CASE WHEN batch_name = 'test_batch' AND status = 'pending' THEN {AS_OF} ELSE updated_at END AS updated_at FROM state""", text="updated_at")
def _(spark, d):
    state = queue.latest_status(view(spark, d, "queue_log"))
    return queue.complete_batch(state, "test_batch", processed()).select("id", "batch_name", "status", "updated_at")


@check("queue_override", "queue_log", STATE + """
SELECT id, url, status, error_message FROM state
UNION ALL SELECT id || '_completed', url, 'completed', 'Manually marked complete' FROM state WHERE batch_name = 'test_batch' AND status = 'pending'""")
def _(spark, d):
    state = queue.latest_status(view(spark, d, "queue_log"))
    return queue.override_pending(state, "test_batch", processed()).select("id", "url", "status", "error_message")


@check("add_company", "companies", f"""
, new AS (SELECT item_id AS pos, trim('  New ' || CAST(item_id AS VARCHAR) || ' ') AS name, CASE WHEN item_id % 2 = 0 THEN 'Oslo' ELSE 'Unknown' END AS loc FROM benchmark)
, base AS (SELECT 1000 + CAST(row_number() OVER (ORDER BY portco_name) AS BIGINT) AS id, portco_name, portco_location, portco_deal_lead, ai, vehicle FROM companies)
SELECT * FROM base UNION ALL SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY pos), name, loc, 'Unknown', 'false', NULL FROM new""")
def _(spark, d):
    companies, benchmark = load(spark, d, "companies", "benchmark")
    base = ordering.number_rows(companies, F.col("portco_name"), name="id", start=1001)
    i = F.col("item_id")
    new = benchmark.select(
        i.alias("pos"), F.concat(F.lit("  New "), i, F.lit(" ")).alias("name"), F.when(i % 2 == 0, " Oslo").alias("location"),
        F.lit("").alias("deal_lead"), F.lit(" ").alias("vehicle"))
    return transforms.add_company(base, new, processed()).select(*base.select(
        "id", "portco_name", "portco_location", "portco_deal_lead", "ai", "vehicle").columns)


# ---- files: written from a view, read back by the source under test


@check("ingest_delimited", "submitted", """
SELECT trim(url) AS url, 'Head; "' || CAST(pos AS VARCHAR) || '"' AS headline, CASE WHEN pos % 3 = 0 THEN NULL ELSE CAST(10 + pos % 20 AS VARCHAR) || ' Sep 2025' END AS publish_date,
  'site ' || CAST(pos % 7 AS VARCHAR) AS publication, CAST(NULL AS VARCHAR) AS brand FROM submitted""")
def _(spark, d):
    path = new_dir(spark, "export")
    i = F.col("pos")
    view(spark, d, "submitted").select(
        F.col("url").alias("URL"), F.concat(F.lit('Head; "'), i, F.lit('"')).alias("Headline"),
        F.when(i % 3 == 0, "NA").otherwise(F.concat(10 + i % 20, F.lit(" Sep 2025"))).alias("Publish Date"),
        F.lit("9").alias("Publication Reach"), F.concat(F.lit("site "), i % 7).alias("Publication Name"),
    ).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.read_delimited(spark, path).drop("pos")


@check("ingest_url_list", "submitted", "SELECT trim(url) AS url FROM submitted WHERE trim(url) <> ''")
def _(spark, d):
    path = new_dir(spark, "urls")
    lines = view(spark, d, "submitted").select(F.explode(F.array(F.col("url"), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return files.read_url_list(spark, path)


@check("ingest_mention_feed", "mentions", "SELECT url, title, summary, author_name, author_url FROM mentions")
def _(spark, d):
    path = new_dir(spark, "feed")
    item = F.struct("url", "title", "summary", F.struct(F.col("author_name").alias("name"), F.col("author_url").alias("url")).alias("author"))
    view(spark, d, "mentions").groupBy("conv_id").agg(F.collect_list(item).alias("items")).select("items").write.json(path)
    return files.read_mention_feed(spark, path, multi_line=False)


@check("append_articles", "tracked", "SELECT id, url, updated_at, month FROM tracked", text="id updated_at month")
def _(spark, d):
    path = new_dir(spark, "articles")
    rows = conform(view(spark, d, "tracked"))
    first = F.col("social_shares_count") < 7
    tables.append_articles(rows.filter(first), path, f"{path}-rejects")
    tables.append_articles(rows.filter(~first), path, f"{path}-rejects")
    return tables.read_or_empty(spark, path, schemas.ARTICLES).select("id", "url", "updated_at", "month")


@check("append_batches", "tracked", "SELECT id, url, updated_at, month FROM tracked", text="id updated_at month")
def _(spark, d):
    path = new_dir(spark, "articles")
    rows = conform(view(spark, d, "tracked"))
    first = F.col("social_shares_count") < 7
    for name, part in (("first", rows.filter(first)), ("rest", rows.filter(~first)), ("first", rows.filter(first))):  # one is sent twice
        tables.append_batch(part, path, name, f"{path}-rejects")
    return tables.read_batches(spark, path, schemas.ARTICLES).select("id", "url", "updated_at", "month")


@check("append_rejects", "submitted", """
SELECT trim(url) AS url, 'Invalid URL format' AS errors FROM submitted WHERE NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')""")
def _(spark, d):
    path = new_dir(spark, "articles")
    rows = conform(view(spark, d, "submitted").select(F.trim("url").alias("url")))
    tables.append_articles(rows, path, f"{path}-rejects")
    return spark.read.parquet(f"{path}-rejects").select("url", F.array_join("errors", "; ").alias("errors"))


@check("swap_months", "tracked", """
SELECT id, url, CASE WHEN month IS NULL THEN 'swapped' ELSE title END AS title FROM tracked""", text="id")
def _(spark, d):
    path = new_dir(spark, "articles")
    rows = conform(view(spark, d, "tracked"))
    tables.append_articles(rows, path)
    tables.swap_months(rows.filter("month IS NULL").withColumn("title", F.lit("swapped")), path)
    return spark.read.schema(schemas.ARTICLES).parquet(path).select("id", "url", "title")


@check("create_if_absent", "queue_log", STATE + "SELECT id, url, status, batch_name FROM state")
def _(spark, d):
    path = new_dir(spark, "queue")
    assert tables.read_or_empty(spark, path, schemas.QUEUE).isEmpty()
    tables.create_if_absent(spark, path, schemas.QUEUE)
    conform(queue.latest_status(view(spark, d, "queue_log")), schemas.QUEUE).write.mode("append").parquet(path)
    return tables.create_if_absent(spark, path, schemas.QUEUE).select("id", "url", "status", "batch_name")


# ---- whole jobs


def _people(kind: str, dictionary: str, name: str, *extra: str) -> str:
    each = "".join(f", {e}" for e in extra)
    return (f", {kind} AS (SELECT a.k, {listed('p.' + name)} AS names{each} FROM deep a JOIN {dictionary} p "
            f"ON {found_sql('a.content', 'p.' + name)} GROUP BY 1)")


# every article once, keyed by its (unique) update time; rows without an id get the next free ones
ENRICHED = f"""
, numbered AS (SELECT t.*, t.updated_at AS k, CASE WHEN id IS NULL THEN (SELECT max(id) FROM tracked)
    + row_number() OVER (PARTITION BY id IS NULL ORDER BY updated_at, url) ELSE id END AS new_id FROM tracked t)
, deep AS (SELECT * FROM numbered WHERE length(trim(coalesce(content, ''))) >= 20)
{_people('sp', 'people', 'spokesperson_name')}
{_people('inv', 'investors', 'investor', listed('CAST(p.rank AS VARCHAR)') + ' AS ranks')}
{_people('rep', 'reporters', 'tagged_reporter')}
{_people('com', 'companies', 'portco_name', listed('p.portco_location') + ' AS locations', listed('p.portco_deal_lead') + ' AS leads',
         listed('p.ai') + ' AS ais', listed('p.vehicle') + ' AS vehicles')}
, flags AS (SELECT k, {family_sql('content', 'kp', FAMILY_ONE)}, {family_sql('content', 'uw', FAMILY_TWO)},
    EXISTS (SELECT 1 FROM people p WHERE {found_sql('title', 'p.spokesperson_name')}) AS in_head FROM deep)
, dim AS (SELECT * FROM (SELECT *, lower(replace(domain, 'www.', '')) AS nd,
    row_number() OVER (PARTITION BY lower(replace(domain, 'www.', '')) ORDER BY id) AS rn FROM media_data) WHERE rn = 1)
, enriched AS (SELECT n.k, n.new_id AS id, n.url, n.content, n.title,
    coalesce(n.cleaned_url, {clean_sql('n.url')}) AS cleaned_url,
    coalesce(n.domain, {known_domain_sql('n.domain', 'n.url')}) AS domain,
    coalesce(n.publish_date, CAST({AS_OF} AS DATE)) AS publish_date,
    CAST(date_trunc('month', coalesce(n.publish_date, CAST({AS_OF} AS DATE))) AS DATE) AS month,
    coalesce(n.language, CASE WHEN regexp_matches(coalesce(n.content, ''), '\\p{{Han}}') THEN 'zh' ELSE 'en' END) AS language,
    {word_sql('n.title', BRAND)} AS brand_in_headline,
    ({word_sql('n.content', BRAND)} OR {word_sql('n.title', BRAND)} OR lower(coalesce(n.managed_by_fund, '')) = '{BRAND}') AS tagged_brand,
    coalesce(sp.names, n.matched_spokespeople) AS matched_spokespeople,
    coalesce(inv.names, n.matched_vc_investors) AS matched_vc_investors, inv.ranks AS matched_dealroom_rank,
    coalesce(rep.names, n.matched_reporter) AS matched_reporter,
    coalesce(com.names, n.matched_portcos) AS matched_portcos, com.locations AS matched_portco_location,
    com.leads AS matched_portco_deal_lead, com.ais AS matched_portco_ai,
    CASE WHEN com.k IS NOT NULL THEN com.vehicles ELSE n.matched_vehicle END AS matched_vehicle,
    CASE WHEN f.k IS NOT NULL THEN coalesce(coalesce(com.names, n.matched_portcos) <> '', FALSE) ELSE n.tagged_portco END AS tagged_portco,
    CASE WHEN f.k IS NOT NULL THEN coalesce(coalesce(com.names, n.matched_portcos) <> '', FALSE) AND NOT coalesce({word_sql('n.title', BRAND)}, FALSE)
      ELSE n.unbranded_win END AS unbranded_win,
    f.in_head AS spokespeople_in_headline,
    CASE WHEN f.k IS NOT NULL THEN kp ELSE n.kill_pill END AS kill_pill,
    CASE WHEN f.k IS NOT NULL THEN kp_count ELSE n.kill_pill_count END AS kill_pill_count,
    CASE WHEN f.k IS NOT NULL THEN kp_context ELSE n.kill_pill_context END AS kill_pill_context,
    CASE WHEN f.k IS NOT NULL THEN uw ELSE n.unwanted END AS unwanted,
    CASE WHEN f.k IS NOT NULL THEN uw_count ELSE n.unwanted_count END AS unwanted_count,
    CASE WHEN f.k IS NOT NULL THEN uw_context ELSE n.unwanted_context END AS unwanted_context,
    CASE WHEN f.k IS NOT NULL THEN coalesce(n.country, dim.country) ELSE n.country END AS country,
    CASE WHEN f.k IS NOT NULL THEN coalesce(n.page_rank, dim.page_rank) ELSE n.page_rank END AS page_rank,
    CASE WHEN f.k IS NOT NULL THEN coalesce(n.tier, dim.tier) ELSE n.tier END AS tier
  FROM numbered n LEFT JOIN flags f ON n.k = f.k LEFT JOIN sp ON n.k = sp.k LEFT JOIN inv ON n.k = inv.k
  LEFT JOIN rep ON n.k = rep.k LEFT JOIN com ON n.k = com.k
  LEFT JOIN dim ON lower(replace(coalesce(n.domain, {known_domain_sql('n.domain', 'n.url')}, ''), 'www.', '')) = dim.nd)
"""
ENRICH_VIEWS = "tracked people investors reporters companies media_data"
ENRICHED_COLUMNS = [
    "id", "url", "content", "title", "cleaned_url", "domain", "publish_date", "month", "language", "brand_in_headline",
    "tagged_brand", "matched_spokespeople", "matched_vc_investors", "matched_dealroom_rank", "matched_reporter",
    "matched_portcos", "matched_portco_location", "matched_portco_deal_lead", "matched_portco_ai", "matched_vehicle",
    "tagged_portco", "unbranded_win", "spokespeople_in_headline", "kill_pill", "kill_pill_count", "kill_pill_context", "unwanted",
    "unwanted_count", "unwanted_context", "country", "page_rank", "tier",
]
NULLABLE = ("publish_date month tagged_portco unbranded_win spokespeople_in_headline kill_pill kill_pill_count unwanted unwanted_count page_rank")


def dictionaries(spark, d) -> enrich.Dictionaries:
    return enrich.Dictionaries(*load(spark, d, "people", "investors", "reporters", "companies", "media_data"))


def enriched(spark, d, rows="tracked", **options):
    source = view(spark, d, rows) if isinstance(rows, str) else rows
    return enrich.enrich_articles(
        source, dictionaries(spark, d), BRAND, processed(), kill_pill=FAMILY_ONE, unwanted=FAMILY_TWO, **options)


@check("enrich_articles", ENRICH_VIEWS, ENRICHED + f"SELECT {', '.join(ENRICHED_COLUMNS)} FROM enriched", text=NULLABLE)
def _(spark, d):
    return enriched(spark, d).select(*ENRICHED_COLUMNS)


@check("write_log", ENRICH_VIEWS, ENRICHED + """
, steps AS (SELECT unnest(CASE WHEN length(trim(coalesce(content, ''))) < 20 THEN ['START', 'ASSIGN_ID', 'NORMALIZE', 'GUARD_CONTENT', 'SKIP']
  ELSE ['START', 'ASSIGN_ID', 'NORMALIZE', 'GUARD_CONTENT', 'ENRICH_SPOKES', 'ENRICH_INVESTORS', 'ENRICH_REPORTERS', 'ENRICH_PORTCOS', 'KEYWORDS', 'MEDIA_META', 'DONE'] END) AS step FROM enriched)
SELECT step, CASE WHEN step = 'SKIP' THEN 'WARN' ELSE 'INFO' END AS severity, count(*) AS n FROM steps GROUP BY 1, 2""")
def _(spark, d):
    return run_summary(enrich.enrichment_log(enriched(spark, d), F.lit("run-1"), processed(), processed()))


# every fifth number of shares stands for a row that the KEYWORDS step breaks at: its flags stay, the other steps are done
BROKEN = "social_shares_count % 5 = 3"
LONG_ENOUGH = "length(trim(coalesce(e.content, ''))) >= 20"


def broken(spark, d):
    return enrich.enrich_with_errors(
        view(spark, d, "tracked"), dictionaries(spark, d), BRAND, processed(), kill_pill=FAMILY_ONE, unwanted=FAMILY_TWO,
        fails={"KEYWORDS": F.when(F.expr(BROKEN), "broken row")})


@check("enrich_step_errors", ENRICH_VIEWS, ENRICHED + f"""
SELECT e.id, e.url, {", ".join(f"CASE WHEN {LONG_ENOUGH} AND {BROKEN} THEN t.{c} ELSE e.{c} END AS {c}" for c in ("kill_pill", "kill_pill_count", "unwanted"))},
  e.country, e.matched_portcos, CASE WHEN {LONG_ENOUGH} AND {BROKEN} THEN 'KEYWORDS: broken row' ELSE '' END AS step_errors
FROM enriched e JOIN tracked t ON t.updated_at = e.k""", text="kill_pill kill_pill_count unwanted")
def _(spark, d):
    found = F.array_join(F.transform("step_errors", lambda e: F.concat_ws(": ", e["step"], e["message"])), "; ")
    return broken(spark, d).select("id", "url", "kill_pill", "kill_pill_count", "unwanted", "country", "matched_portcos", found.alias("step_errors"))


@check("write_log_errors", ENRICH_VIEWS, ENRICHED + f"""
, steps AS (SELECT social_shares_count, unnest(CASE WHEN {LONG_ENOUGH} THEN ['START', 'ASSIGN_ID', 'NORMALIZE', 'GUARD_CONTENT', 'ENRICH_SPOKES', 'ENRICH_INVESTORS',
    'ENRICH_REPORTERS', 'ENRICH_PORTCOS', 'KEYWORDS', 'MEDIA_META', 'DONE'] ELSE ['START', 'ASSIGN_ID', 'NORMALIZE', 'GUARD_CONTENT', 'SKIP'] END) AS step
  FROM enriched e JOIN tracked t ON t.updated_at = e.k)
SELECT step, CASE WHEN step = 'SKIP' THEN 'WARN' WHEN step = 'KEYWORDS' AND {BROKEN} THEN 'ERROR' ELSE 'INFO' END AS severity, count(*) AS n FROM steps GROUP BY 1, 2""")
def _(spark, d):
    return run_summary(enrich.enrichment_log(broken(spark, d), F.lit("run-1"), processed(), processed()))


@check("audit_sink", ENRICH_VIEWS, ENRICHED + """
SELECT url, 'ASSIGN_ID' AS step, 'INFO' AS severity, 'resolved id' AS message, '{"id":' || CAST(id AS VARCHAR) || '}' AS context FROM enriched
UNION ALL SELECT url, 'SKIP', 'WARN', 'content too short (<20)', '{"id":' || CAST(id AS VARCHAR) || '}' FROM enriched WHERE length(trim(coalesce(content, ''))) < 20""")
def _(spark, d):
    path = new_dir(spark, "log")
    tables.append_log(enrich.enrichment_log(enriched(spark, d), F.lit("run-1"), processed(), processed()), path)
    stored = tables.read_or_empty(spark, path, schemas.STEP_LOG).filter(F.col("step").isin("ASSIGN_ID", "SKIP"))
    return stored.select("url", "step", "severity", "message", "context")


BACKLOG = f"""
, filled AS (SELECT {FILLED_LIST} FROM SOURCE)
, looked AS (SELECT f.* REPLACE (CASE WHEN m.domain IS NOT NULL AND (f.country = '' OR f.tier = '') THEN m.country ELSE f.country END AS country,
    CASE WHEN m.domain IS NOT NULL AND (f.country = '' OR f.tier = '') THEN m.tier ELSE f.tier END AS tier,
    CASE WHEN f.language = '' AND f.content <> '' THEN 'en' ELSE f.language END AS language,
    CASE WHEN f.title <> '' THEN contains(lower(f.title), '{BRAND}') ELSE f.brand_in_headline END AS brand_in_headline)
  FROM filled f LEFT JOIN media_data m ON f.domain = m.domain)
"""


@check("enrich_backlog", "tracked media_data", BACKLOG.replace("SOURCE", "tracked") + "SELECT * FROM looked", text=TIMES)
def _(spark, d):
    rows, media = load(spark, d, "tracked", "media_data")
    return enrich.enrich_backlog(rows, media, BRAND, processed()).select(*FILLED_COLUMNS)


_UPDATED = """
, waiting AS (SELECT DISTINCT id FROM tracked WHERE (content IS NULL OR content = '') AND url IS NOT NULL)
, updated AS (SELECT t.* REPLACE (CASE WHEN b.id IS NOT NULL THEN b.content ELSE t.content END AS content,
    CASE WHEN b.id IS NOT NULL THEN coalesce(nullif(t.title, ''), b.title) ELSE t.title END AS title,
    CASE WHEN b.id IS NOT NULL THEN coalesce(t.publish_date, CAST(try_strptime(b.publish_date, '%Y-%m-%d') AS DATE)) ELSE t.publish_date END AS publish_date,
    CASE WHEN b.id IS NOT NULL THEN FALSE ELSE t.data_ingestion END AS data_ingestion)
  FROM tracked t LEFT JOIN (SELECT * FROM bodies WHERE length(content) > 50 AND id IN (SELECT id FROM waiting)) b ON t.id = b.id)
"""


@check("fill_all_cells", "tracked bodies media_data", _UPDATED + BACKLOG.replace("SOURCE", "updated")
       + f"SELECT * FROM ({report_sql('tracked', ', ' + repr('before') + ' AS stage')}) UNION ALL SELECT * FROM ({report_sql('(SELECT l.*, u.publish_date FROM looked l JOIN updated u ON l.updated_at = u.updated_at)', ', ' + repr('after') + ' AS stage')})")
def _(spark, d):
    rows, bodies, media = load(spark, d, "tracked", "bodies", "media_data")
    return enrich.fill_all_cells(rows, bodies, media, BRAND, processed())[1]


def _row_view(name: str) -> str:
    """Intake rows with their page fields, as the export and the pages give them."""
    return f"""
, pg AS (SELECT page_id, url, {TITLE_SQL} AS t, {BODY_SQL} AS body FROM pages)
{snippet_sql('pg', 'page_id', 'body', [BRAND])}
, page_fields AS (SELECT url, arg_min(coalesce(t, CASE WHEN length(snippet) > 100 THEN substr(snippet, 1, 100) || '...' ELSE nullif(snippet, '') END), page_id) AS page_title,
    arg_min({host_sql('url')}, page_id) AS page_domain, arg_min(snippet, page_id) AS page_content FROM pg JOIN snippet ON k = page_id GROUP BY url)
, export AS (SELECT pos, trim(url) AS url, CASE WHEN pos % 4 = 1 THEN '' ELSE 'Head ' || CAST(pos AS VARCHAR) END AS headline,
    CASE WHEN pos % 3 = 0 THEN NULL ELSE make_date(2025, 9, CAST(10 + pos % 20 AS INT)) END AS given_date,
    CASE pos % 5 WHEN 0 THEN 'Thble' WHEN 1 THEN 'Acme' ELSE '' END AS brand FROM submitted)
, {name} AS (SELECT e.pos, e.url, coalesce(nullif(e.headline, ''), p.page_title, '') AS title,
    coalesce(e.given_date, CASE WHEN p.url IS NOT NULL THEN {PROCESSED} END) AS publish_date,
    coalesce(p.page_domain, '') AS domain, coalesce(p.page_content, '') AS content,
    contains(lower(e.brand || '|' || coalesce(p.page_content, '') || '|' || coalesce(nullif(e.headline, ''), p.page_title, '')), '{BRAND}') AS tagged_brand,
    CASE WHEN lower(e.brand) <> '{BRAND}' THEN e.brand ELSE '' END AS matched_portcos,
    split_part(split_part(e.url, '?', 1), '#', 1) AS cleaned_url
  FROM export e LEFT JOIN page_fields p ON e.url = p.url)
"""


def _export(spark, d):
    i = F.col("pos")
    return view(spark, d, "submitted").select(
        "pos", F.trim("url").alias("url"), F.when(i % 4 == 1, "").otherwise(F.concat(F.lit("Head "), i)).alias("headline"),
        F.when(i % 3 != 0, F.concat(10 + i % 20, F.lit(" Sep 2025"))).alias("publish_date"),
        F.when(i % 5 == 0, "Thble").when(i % 5 == 1, "Acme").otherwise("").alias("brand"))


@check("ingest_row_build", "submitted", _row_view("built") + "SELECT * FROM built", text="publish_date")
def _(spark, d):
    from pressgrid.functions.pages import extract_pages
    fields = extract_pages(view(spark, d, "pages"), "light", processed(), [BRAND]).select(
        "url", F.col("title").alias("page_title"), F.col("publish_date").alias("page_date"),
        F.col("domain").alias("page_domain"), F.col("content").alias("page_content"), "page_id")
    one = fields.groupBy("url").agg(F.min_by(F.struct("page_title", "page_date", "page_domain", "page_content"), "page_id").alias("p")).select("url", "p.*")
    rows = _export(spark, d).join(one, "url", "left")
    return transforms.ingest_row_build(rows, BRAND, processed()).drop("updated_at", "data_ingestion")


@check("bulk_ingest", "submitted tracked media_data", _row_view("built") + f"""
, base AS (SELECT * REPLACE ({norm_sql('url')} AS url) FROM tracked)
, fresh AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn FROM built WHERE url <> '' AND {norm_sql('url')} NOT IN (SELECT url FROM base))
, both_rows AS (SELECT * FROM base UNION ALL BY NAME
    SELECT (SELECT max(id) FROM base) + rn AS id, url, title, publish_date, domain, content, {AS_OF} + to_seconds(CAST(rn - 1 AS BIGINT)) AS updated_at,
      TRUE AS data_ingestion, tagged_brand, matched_portcos, cleaned_url FROM fresh)
""" + BACKLOG.replace("SOURCE", "both_rows") + "SELECT * FROM looked", text=TIMES)
def _(spark, d):
    rows, pages, media = load(spark, d, "tracked", "pages", "media_data")
    done = intake.bulk_ingest(_export(spark, d), normal_articles(rows), pages, media, BRAND, processed())
    return done.select(*FILLED_COLUMNS)


@check("bulk_ingest_file", "submitted tracked media_data", _row_view("built") + f"""
, base AS (SELECT * REPLACE ({norm_sql('url')} AS url) FROM tracked)
, fresh AS (SELECT *, row_number() OVER (ORDER BY pos) AS rn FROM built WHERE url <> '' AND {norm_sql('url')} NOT IN (SELECT url FROM base))
, both_rows AS (SELECT * FROM base UNION ALL BY NAME
    SELECT (SELECT max(id) FROM base) + rn AS id, url, title, publish_date, domain, content, {AS_OF} + to_seconds(CAST(rn - 1 AS BIGINT)) AS updated_at,
      TRUE AS data_ingestion, tagged_brand, matched_portcos, cleaned_url FROM fresh WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+'))
""" + BACKLOG.replace("SOURCE", "both_rows") + "SELECT * FROM looked", text=TIMES)
def _(spark, d):
    path = new_dir(spark, "ingest")
    rows, pages, media = load(spark, d, "tracked", "pages", "media_data")
    tables.append_batch(conform(normal_articles(rows)), f"{path}/articles", "before")
    _export(spark, d).withColumnRenamed("pos", "line").write.option("header", True).csv(f"{path}/export")
    for _ in range(2):  # the job is run again and adds nothing
        done = intake.ingest_file(spark, f"{path}/export", f"{path}/articles", pages, media, BRAND, processed(), "export-1", f"{path}/rejects")
    return done.select(*FILLED_COLUMNS)


@check("sync_mentions", "mentions articles", MATCHES + """
, added AS (SELECT id, sum(shares) AS n FROM matches GROUP BY 1)
SELECT a.id, a.url, CAST(a.social_shares_count + coalesce(added.n, 0) AS BIGINT) AS social_shares_count FROM articles a LEFT JOIN added ON a.id = added.id""", text="id")
def _(spark, d):
    rows, articles = load(spark, d, "mentions", "articles")
    return intake.sync_mentions(rows, articles, BRAND, processed())[0].select("id", "url", "social_shares_count")


@check("sync_mentions_audit", "mentions articles", MATCHES + """
, added AS (SELECT id, sum(shares) AS n FROM matches GROUP BY 1)
SELECT m.id AS article_id, m.article_url, m.mention_url, m.shares AS shares_added, CAST(a.social_shares_count + added.n AS BIGINT) AS new_total, m.match_kind
FROM matches m JOIN added ON m.id = added.id JOIN articles a ON a.id = m.id""")
def _(spark, d):
    rows, articles = load(spark, d, "mentions", "articles")
    return intake.sync_mentions(rows, articles, BRAND, processed())[1].drop("ts")
