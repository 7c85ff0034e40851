"""Input views over the given tables, in one wording for Spark and DuckDB.

`{documents}` and the like stand for the table, `{ts}` for the engine's
microseconds-to-timestamp function.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ["nation", "documents", "pages", "conversations", "events", "benchmark"]
BRAND = "thble"
FAMILY_ONE = ["thing", "thtion"]
FAMILY_TWO = ["attion", "that and"]
OWN_SITE = "brand.example"

_ARTICLE = """
SELECT CASE WHEN doc_id % 97 = 0 THEN NULL ELSE doc_id END AS id,
  'https://' || CASE WHEN slug % 4 = 0 THEN 'www.' ELSE '' END || 'src' || CAST(slug % 20 AS STRING) || '.example.com/'
    || CAST(slug AS STRING) || CASE WHEN doc_id % 5 = 0 THEN '/?utm_source=feed#top' ELSE '' END AS url,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN '' ELSE substr(text, 1, 60) END AS title,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'needs enrichment' ELSE text END AS content,
  CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CASE WHEN slug % 4 = 0 THEN 'www.' ELSE '' END || 'src' || CAST(slug % 20 AS STRING) || '.example.com' END AS domain,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 366 AS INT) END AS publish_date,
  {ts}(1717200000000000 + ((doc_id * 37) % 100000) * 60000000) AS updated_at,
  doc_id % 3 = 0 AS data_ingestion,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN '' ELSE 'DE' END AS country,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN '' ELSE 'Tier 2' END AS tier,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 12 = 0 THEN '' ELSE lang END AS language,
  CASE WHEN doc_id % 21 = 0 THEN 'thble' ELSE NULL END AS managed_by_fund,
  doc_id % 14 AS social_shares_count{more}
FROM (SELECT *, doc_id - CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 0 END AS slug FROM {documents}) AS b
"""

# enrichment and tracking columns in a half-filled state
_TRACKED = """,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE 'the nt, thing, was and, nobody here at all' END AS matched_spokespeople,
  CASE WHEN doc_id % 3 = 1 THEN 'thble' ELSE NULL END AS matched_vc_investors,
  CASE WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 = 3 THEN '' ELSE 'attion' END AS matched_portcos,
  CASE WHEN doc_id % 8 = 3 THEN NULL ELSE 'the nt' END AS matched_reporter,
  CASE WHEN doc_id % 6 = 1 THEN NULL ELSE 'Fund 1' END AS matched_vehicle,
  CASE WHEN doc_id % 16 = 5 THEN NULL ELSE doc_id % 2 = 0 END AS tagged_brand,
  CASE WHEN doc_id % 15 = 4 THEN NULL ELSE doc_id % 4 = 1 END AS tagged_portco,
  CASE WHEN doc_id % 14 = 3 THEN NULL ELSE doc_id % 5 = 1 END AS kill_pill,
  CASE WHEN doc_id % 14 = 3 THEN NULL ELSE 'a hit' END AS kill_pill_context,
  CASE WHEN doc_id % 14 = 3 THEN NULL ELSE doc_id % 3 END AS kill_pill_count,
  CASE WHEN doc_id % 18 = 3 THEN NULL ELSE doc_id % 6 = 1 END AS unwanted,
  CASE WHEN doc_id % 18 = 3 THEN NULL ELSE '' END AS unwanted_context,
  CASE WHEN doc_id % 18 = 3 THEN NULL ELSE doc_id % 4 END AS unwanted_count,
  CASE WHEN doc_id % 22 = 3 THEN NULL ELSE DATE '2024-02-01' END AS month,
  CASE WHEN doc_id % 26 = 3 THEN NULL ELSE doc_id % 9 = 1 END AS brand_in_headline,
  CASE WHEN doc_id % 25 = 3 THEN NULL ELSE FALSE END AS unbranded_win,
  CASE WHEN doc_id % 27 = 3 THEN NULL WHEN doc_id % 27 = 4 THEN '' ELSE 'src.example.com' END AS cleaned_url,
  CASE WHEN doc_id % 20 = 3 THEN NULL ELSE doc_id % 2 = 1 END AS text_scraped,
  CASE WHEN doc_id % 33 = 3 THEN NULL ELSE doc_id % 11 END AS page_rank"""

VIEWS = {
    "articles": _ARTICLE.replace("{more}", ""),
    "tracked": _ARTICLE.replace("{more}", _TRACKED),
    "media_data": """
SELECT CAST(n_nationkey AS BIGINT) AS id,
  'src' || CAST(n_nationkey AS STRING) || '.example.com' AS domain, n_name AS country,
  CAST(n_nationkey % 9 AS BIGINT) AS page_rank, CAST(n_nationkey % 11 AS BIGINT) AS llm_rank,
  CAST(n_nationkey % 4 AS BIGINT) AS hn_citation, CAST(n_nationkey % 6 + 2 AS BIGINT) AS signal_score,
  CASE WHEN n_nationkey % 9 < 5 THEN 'Tier 3' WHEN n_nationkey % 9 < 7 THEN 'Tier 2' ELSE 'Tier 1' END AS tier
FROM {nation} WHERE n_nationkey <> 7
""",
    "companies": """
SELECT portco_name, 'city' || CAST(k % 5 AS STRING) AS portco_location,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'lead' || CAST(k % 4 AS STRING) END AS portco_deal_lead,
  'false' AS ai, 'Fund ' || CAST(k % 4 AS STRING) AS vehicle
FROM (
  SELECT portco_name, k FROM (
    SELECT lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+', 0)) AS portco_name, min(item_id) AS k FROM {benchmark} GROUP BY 1
  ) AS p WHERE portco_name <> '' UNION ALL SELECT 'attion', 900 UNION ALL SELECT 'thtion', 901) AS v
""",
    "people": """
SELECT * FROM (VALUES ('that and'), ('de les'), ('the nt'), ('was and'), ('thing'), ('nobody here')) AS t(spokesperson_name)
""",
    "investors": """
SELECT * FROM (VALUES ('thble', 3), ('as nd', 12), ('attion', 3), ('missing capital', 40)) AS t(investor, rank)
""",
    "reporters": """
SELECT * FROM (VALUES ('the nt'), ('thing'), ('no reporter')) AS t(tagged_reporter)
""",
    "submitted": """
SELECT page_id AS pos,
  CASE WHEN page_id % 3 = 0 THEN ' https://src' || CAST(page_id % 20 AS STRING) || '.example.com/' || CAST(page_id AS STRING) || '/ '
       WHEN page_id % 7 = 0 THEN 'https://www.brand.example/' || CAST(page_id AS STRING)
       WHEN page_id % 13 = 0 THEN 'https://new.example.org/' || CAST(page_id AS STRING)
       WHEN page_id % 11 = 0 THEN '/new.example.org/x/' || CAST(page_id % 22 AS STRING)
       ELSE url END AS url
FROM {pages}
""",
    "queue_log": """
SELECT CAST(entry AS STRING) AS id, 'https://new.example.org/' || CAST(entry AS STRING) AS url,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN event_id % 40 = 0 THEN 'test_batch' ELSE 'batch_' || CAST(entry % 12 AS STRING) END AS batch_name,
  event_id AS seq, CAST(ts AS TIMESTAMP) AS updated_at,
  CASE WHEN event_type = 'error' THEN 'No content extracted' ELSE NULL END AS error_message
FROM (SELECT *, CAST(floor(event_id / 4) AS BIGINT) AS entry FROM {events}) AS e
""",
    "step_log": """
SELECT event_id AS seq, 'run' || CAST(user_id AS STRING) || '-abcdefgh' AS run_id, 'https://new.example.org/' || CAST(event_id AS STRING) AS url,
  CASE event_type WHEN 'view' THEN 'NORMALIZE' WHEN 'click' THEN 'KEYWORDS' WHEN 'error' THEN 'GUARD_CONTENT' ELSE 'MEDIA_META' END AS step,
  CASE WHEN event_id % 7 = 0 THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS severity,
  props AS context, CAST(ts AS TIMESTAMP) AS ts
FROM {events}
""",
    "mentions": """
SELECT conv_id, turn,
  CASE WHEN conv_id % 9 = 0 THEN 'https://news.example.org/' ELSE 'https://x.com/u/' END || CAST(conv_id * 100 + turn AS STRING) AS url,
  CASE WHEN turn % 4 = 3 THEN 'moose seen' WHEN turn % 4 = 2 THEN 'plain words' ELSE 'founder raises seed' END AS title,
  role || ': ' || text || ' see https://' || CASE WHEN turn % 2 = 0 THEN 'www.' ELSE '' END || 'src'
    || CAST((conv_id * 3 + turn) % 20 AS STRING) || '.example.com/' || CAST(conv_id * 3 + turn AS STRING) || CASE WHEN conv_id % 6 = 0 THEN '/more' ELSE '?s=1' END || ' and https://t.co/abc' AS summary,
  CASE WHEN conv_id % 15 = 0 THEN 'Thble Team' ELSE 'user' || CAST(conv_id AS STRING) END AS author_name,
  'https://x.com/user' || CAST(conv_id AS STRING) AS author_url
FROM {conversations}
""",
    # candidate bodies for known articles, one per id
    "bodies": """
SELECT doc_id AS id, 'Body ' || text AS content,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'New title ' || CAST(doc_id AS STRING) END AS title,
  CASE WHEN doc_id % 5 = 0 THEN 'NA' ELSE '2024-05-' || CAST(10 + doc_id % 20 AS STRING) END AS publish_date,
  'src' || CAST(doc_id % 3 AS STRING) || '.example.com' AS domain
FROM {documents}
""",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view (or a plain table) over the parquet files in `folder`."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if name in VIEWS:
        tables = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
        return spark.sql(VIEWS[name].format(ts="timestamp_micros", **tables))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_view(spark: SparkSession, source: DataFrame, table: str, name: str) -> DataFrame:
    """The same view over a streaming table."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    temporary = f"stream_{table}_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(temporary)
    return spark.sql(VIEWS[name].format(ts="timestamp_micros", **{t: temporary for t in TABLES}))


def sql_views(*names: str) -> str:
    """The views as the WITH list of a DuckDB query."""
    texts = [f"{n} AS ({VIEWS[n].format(ts='make_timestamp', **{t: t for t in TABLES}).strip()})" for n in names]
    return "WITH " + ",\n".join(texts)
