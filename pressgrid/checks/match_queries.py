"""Existence joins, dimension look-ups, dictionary matching and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrid.checks.registry import check, load
from pressgrid.checks.text_queries import FOREIGN, IN_CONTEXT, ON_PLATFORM, RELEVANT, SOCIAL, URL_RE, match_sql, norm_sql
from pressgrid.checks.views import BRAND, OWN_SITE, view
from pressgrid.operators import joins, mentions, quality, queue
from pressgrid.operators.dictionary import any_found, entries, joined_values, match_names
from pressgrid.operators.domains import impute_domains, signal_profile, upsert_domains
from pressgrid.operators.ordering import first_seen

ROW = ["url", "updated_at", "id"]


def normal_articles(articles):
    """Articles stored under their normalised URL, as the intake stores them."""
    from pressgrid.functions.urls import normalize_url
    return articles.withColumn("url", normalize_url(F.col("url")))


@check("existing_urls", "submitted articles", f"""
SELECT pos, url FROM submitted WHERE {norm_sql('url')} IN (SELECT {norm_sql('url')} FROM articles)""")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    return joins.existing_urls(submitted, normal_articles(articles))


@check("new_rows_only", "submitted articles", f"""
SELECT pos, url FROM submitted WHERE trim(url) <> '' AND {norm_sql('url')} NOT IN (SELECT {norm_sql('url')} FROM articles)""")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    return joins.new_rows_only(submitted, normal_articles(articles))


@check("classify_urls", "submitted articles queue_log", f"""
, u AS (SELECT DISTINCT {norm_sql('url')} AS url FROM submitted)
SELECT url, CASE WHEN url IN (SELECT {norm_sql('url')} FROM articles) THEN 'in_main_table'
  WHEN url IN (SELECT replace(url, 'new.example.org/', 'new.example.org/x/') FROM queue_log) THEN 'in_queue' ELSE 'new' END AS status FROM u""")
def _(spark, d):
    submitted, articles, log = load(spark, d, "submitted", "articles", "queue_log")
    log = log.withColumn("url", F.replace("url", F.lit("new.example.org/"), F.lit("new.example.org/x/")))
    return joins.classify_urls(submitted, normal_articles(articles), log)


MEDIA_NORM = """
, dim AS (SELECT * FROM (SELECT *, lower(replace(domain, 'www.', '')) AS nd,
    row_number() OVER (PARTITION BY lower(replace(domain, 'www.', '')) ORDER BY id) AS rn FROM media_data) WHERE rn = 1)
"""


@check("domain_lookup", "tracked media_data", MEDIA_NORM + """
SELECT t.updated_at, coalesce(t.country, dim.country) AS country, coalesce(t.page_rank, dim.page_rank) AS page_rank,
  coalesce(t.tier, dim.tier) AS tier
FROM tracked t LEFT JOIN dim ON lower(replace(coalesce(t.domain, ''), 'www.', '')) = dim.nd""", text="updated_at page_rank")
def _(spark, d):
    rows, media = load(spark, d, "tracked", "media_data")
    return joins.domain_lookup(rows, media, ROW).select("updated_at", "country", "page_rank", "tier")


@check("domain_lookup_exact", "articles media_data", """
SELECT t.updated_at, CASE WHEN m.domain IS NOT NULL AND (t.country = '' OR t.tier = '') THEN m.country ELSE t.country END AS country,
  CASE WHEN m.domain IS NOT NULL AND (t.country = '' OR t.tier = '') THEN m.tier ELSE t.tier END AS tier
FROM articles t LEFT JOIN media_data m ON t.domain = m.domain""", text="updated_at")
def _(spark, d):
    rows, media = load(spark, d, "articles", "media_data")
    return joins.domain_lookup_exact(rows, media, ROW).select("updated_at", "country", "tier")


def found_sql(text: str, name: str) -> str:
    """Exact test of a quoted name in a padded text."""
    return (f"regexp_matches(' ' || lower(coalesce({text}, '')) || ' ', "
            f"'[^a-z0-9]' || regexp_escape(lower({name})) || '[^a-z0-9]')")


def listed(column: str) -> str:
    return f"string_agg(DISTINCT {column}, ', ' ORDER BY {column})"


def _names(spark, d, dictionary: str, name: str, text: str = "content", how: str = "auto", **attrs):
    articles, names = load(spark, d, "articles", dictionary)
    slim = articles.select("id", "url", "updated_at", text)
    return match_names(slim, entries(names, name, **attrs), {"found": F.col(text)}, how).drop(text)


def listed_only(value):
    """Rows with a value only. A filter would be moved below the matching and repeat it; explode is not."""
    return F.explode(F.array_compact(F.array(value)))


@check("match_spokespeople", "articles people", f"""
SELECT a.updated_at, a.url, {listed('p.spokesperson_name')} AS people FROM articles a
JOIN people p ON {found_sql('a.content', 'p.spokesperson_name')} GROUP BY 1, 2""", text="updated_at")
def _(spark, d):
    found = _names(spark, d, "people", "spokesperson_name")
    return found.select("updated_at", "url", listed_only(joined_values("found", "name")).alias("people"))


@check("match_investors", "articles investors", f"""
SELECT a.updated_at, a.url, {listed('p.investor')} AS investors, {listed('CAST(p.rank AS VARCHAR)')} AS ranks FROM articles a
JOIN investors p ON {found_sql('a.content', 'p.investor')} GROUP BY 1, 2""", text="updated_at")
def _(spark, d):
    found = _names(spark, d, "investors", "investor", rank="rank")
    return found.select(
        "updated_at", "url", listed_only(joined_values("found", "name")).alias("investors"),
        joined_values("found", "rank").alias("ranks"))


@check("match_reporters", "articles reporters", f"""
SELECT a.updated_at, a.url, {listed('p.tagged_reporter')} AS reporters FROM articles a
JOIN reporters p ON {found_sql('a.content', 'p.tagged_reporter')} GROUP BY 1, 2""", text="updated_at")
def _(spark, d):
    found = _names(spark, d, "reporters", "tagged_reporter")
    return found.select("updated_at", "url", listed_only(joined_values("found", "name")).alias("reporters"))


COMPANY = dict(location="portco_location", lead="portco_deal_lead", ai="ai", vehicle="vehicle")


@check("match_companies", "articles companies", f"""
, m AS (SELECT a.updated_at, {listed('p.portco_name')} AS portcos, {listed('p.portco_location')} AS locations,
    {listed('p.portco_deal_lead')} AS leads, {listed('p.ai')} AS ai, {listed('p.vehicle')} AS vehicles
  FROM articles a JOIN companies p ON {found_sql('a.content', 'p.portco_name')} GROUP BY 1)
SELECT a.updated_at, a.url, portcos, locations, leads, ai, vehicles, coalesce(portcos <> '', FALSE) AS tagged_portco
FROM articles a LEFT JOIN m ON a.updated_at = m.updated_at""", text="updated_at")
def _(spark, d):
    found = _names(spark, d, "companies", "portco_name", **COMPANY)
    each = {"portcos": "name", "locations": "location", "leads": "lead", "ai": "ai", "vehicles": "vehicle"}
    return found.select(
        "updated_at", "url", *[joined_values("found", f).alias(o) for o, f in each.items()],
        any_found("found").alias("tagged_portco"))


@check("name_in_headline", "articles people", f"""
SELECT updated_at, url, EXISTS (SELECT 1 FROM people p WHERE {found_sql('title', 'p.spokesperson_name')}) AS in_headline FROM articles""", text="updated_at")
def _(spark, d):
    found = _names(spark, d, "people", "spokesperson_name", "title")
    return found.select("updated_at", "url", any_found("found").alias("in_headline"))


@check("distinct_concat", "articles companies", f"""
SELECT a.domain, {listed('p.portco_name')} AS companies FROM articles a
JOIN companies p ON {found_sql('a.content', 'p.portco_name')} GROUP BY 1""")
def _(spark, d):
    articles, companies = load(spark, d, "articles", "companies")
    slim = articles.select("id", "url", "updated_at", "domain", "content")
    # the join form, as for a dictionary too large to travel with the scan
    found = match_names(slim, entries(companies, "portco_name"), {"found": F.col("content")}, "join")
    named = found.select("domain", F.explode("found").alias("f")).select("domain", F.col("f.name").alias("name"))
    return quality.distinct_concat(named, ["domain"], "name", "companies")


PROFILE = """
, tiers AS (SELECT page_rank, tier, count(*) AS n FROM media_data GROUP BY 1, 2)
, mode AS (SELECT page_rank, tier AS common_tier FROM (
    SELECT *, row_number() OVER (PARTITION BY page_rank ORDER BY n DESC, tier NULLS FIRST) AS rn FROM tiers) WHERE rn = 1)
, profile AS (SELECT page_rank, avg(llm_rank) AS avg_llm, avg(hn_citation) AS avg_hn, avg(signal_score) AS avg_signal
  FROM media_data GROUP BY 1)
"""


@check("domain_signal_profile", "media_data", PROFILE + """
SELECT page_rank, round(avg_llm, 6) AS avg_llm, round(avg_hn, 6) AS avg_hn, round(avg_signal, 6) AS avg_signal, common_tier
FROM profile JOIN mode USING (page_rank)""")
def _(spark, d):
    rounded = {c: F.round(c, 6) for c in ("avg_llm", "avg_hn", "avg_signal")}
    return signal_profile(view(spark, d, "media_data")).withColumns(rounded)


NEW_DOMAINS = PROFILE + """
, seen AS (SELECT lower(replace(CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE 'src' || CAST(page_id % 30 AS VARCHAR) || '.example.com' END, 'www.', '')) AS domain,
    CASE WHEN page_id % 11 = 10 THEN NULL ELSE page_id % 10 END AS page_rank FROM pages)
, wanted AS (SELECT domain, coalesce(min(page_rank), 3) AS page_rank FROM seen WHERE domain <> '' GROUP BY 1)
, added AS (SELECT domain, w.page_rank,
    CASE WHEN avg_llm <> 0 THEN CAST(trunc(avg_llm) AS BIGINT) ELSE 5 END AS llm_rank,
    CASE WHEN avg_llm <> 0 THEN CASE WHEN avg_hn <> 0 THEN CAST(trunc(avg_hn) AS BIGINT) ELSE 0 END ELSE 0 END AS hn_citation,
    CASE WHEN avg_llm <> 0 THEN CASE WHEN avg_signal <> 0 THEN CAST(trunc(avg_signal) AS BIGINT) ELSE 5 END ELSE 5 END AS signal_score,
    CASE WHEN avg_llm <> 0 THEN coalesce(common_tier, 'Tier 3') WHEN w.page_rank < 5 THEN 'Tier 3' WHEN w.page_rank < 7 THEN 'Tier 2' ELSE 'Tier 1' END AS tier
  FROM wanted w LEFT JOIN profile p ON w.page_rank = p.page_rank LEFT JOIN mode m ON w.page_rank = m.page_rank
  WHERE domain NOT IN (SELECT lower(replace(domain, 'www.', '')) FROM media_data))
"""


def _seen(spark, d):
    i = F.col("page_id")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return view(spark, d, "pages").select(
        F.when(i % 2 == 0, host).otherwise(F.concat(F.lit("src"), i % 30, F.lit(".example.com"))).alias("domain"),
        F.when(i % 11 != 10, i % 10).alias("page_rank"))


@check("impute_domain", "media_data", NEW_DOMAINS + "SELECT * FROM added")
def _(spark, d):
    return impute_domains(_seen(spark, d), view(spark, d, "media_data"))


@check("upsert_domain", "media_data", NEW_DOMAINS + """
SELECT id, domain, page_rank, llm_rank, hn_citation, signal_score, tier, country FROM media_data
UNION ALL SELECT (SELECT max(id) FROM media_data) + row_number() OVER (ORDER BY domain), domain, page_rank, llm_rank, hn_citation, signal_score, tier, NULL FROM added""")
def _(spark, d):
    return upsert_domains(_seen(spark, d), view(spark, d, "media_data"))


@check("first_seen_in_batch", "submitted", f"""
, n AS (SELECT pos, {norm_sql('url')} AS url FROM submitted)
SELECT pos, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM n) WHERE rn = 1""")
def _(spark, d):
    from pressgrid.functions.urls import normalize_url
    return first_seen(view(spark, d, "submitted").withColumn("url", normalize_url(F.col("url"))), "url", "pos").select("pos", "url")


INTAKE = f"""
, n AS (SELECT {norm_sql('url')} AS url, min(pos) AS pos, count(*) AS copies FROM submitted GROUP BY 1)
, intake AS (SELECT url, pos, copies, CASE WHEN contains(lower(url), '{OWN_SITE}') THEN 'own_site'
  WHEN url IN (SELECT {norm_sql('url')} FROM articles) OR url IN (SELECT url FROM queue_log) THEN 'duplicate' ELSE 'added' END AS decision
  FROM n WHERE url <> '')
"""


@check("ingest_summary", "submitted articles queue_log", INTAKE + """
SELECT count(*) FILTER (WHERE decision = 'added') AS added,
  CAST(sum(CASE decision WHEN 'added' THEN copies - 1 WHEN 'duplicate' THEN copies ELSE 0 END) AS BIGINT) AS skipped_duplicates,
  CAST(sum(CASE decision WHEN 'own_site' THEN copies ELSE 0 END) AS BIGINT) AS skipped_own_site,
  CAST(sum(copies) AS BIGINT) AS total_input FROM intake""")
def _(spark, d):
    submitted, articles, log = load(spark, d, "submitted", "articles", "queue_log")
    return quality.ingest_summary(queue.intake(submitted, normal_articles(articles), log, OWN_SITE))


# ---- mentions

COUNTS = f"""
, relevant AS (SELECT * FROM mentions WHERE {RELEVANT})
, raw AS (SELECT unnest(regexp_extract_all(title || ' ' || summary, '{URL_RE}')) AS u FROM relevant)
, counts AS (SELECT {match_sql('u')} AS mention_url, count(*) AS shares FROM raw WHERE NOT regexp_matches(lower(u), '{SOCIAL}')
  AND {match_sql('u')} <> '' GROUP BY 1)
, keys AS (SELECT {match_sql('url')} AS article_url, min(id) AS id FROM articles WHERE id IS NOT NULL AND url IS NOT NULL GROUP BY 1)
, exact AS (SELECT mention_url, shares, id, article_url FROM counts JOIN keys ON mention_url = article_url)
"""
# containment tested pairwise, the longest shared text first, then the smallest id
MATCHES = COUNTS + """
, pairs AS (SELECT mention_url, shares, id, article_url, row_number() OVER (
    PARTITION BY mention_url ORDER BY least(length(mention_url), length(article_url)) DESC, id) AS rn
  FROM counts JOIN keys ON contains(article_url, mention_url) OR contains(mention_url, article_url)
  WHERE mention_url NOT IN (SELECT mention_url FROM exact))
, partial AS (SELECT mention_url, shares, id, article_url FROM pairs WHERE rn = 1)
, matches AS (SELECT *, 'exact' AS match_kind FROM exact UNION ALL SELECT *, 'partial' FROM partial)
"""


def _counts(spark, d):
    found = mentions.relevant_mentions(view(spark, d, "mentions"), BRAND)
    return mentions.url_counts(mentions.mention_urls(found))


@check("mention_url_counts", "mentions articles", COUNTS + "SELECT * FROM counts")
def _(spark, d):
    return _counts(spark, d)


@check("match_mentions_exact", "mentions articles", COUNTS + "SELECT * FROM exact")
def _(spark, d):
    return mentions.match_exact(_counts(spark, d), view(spark, d, "articles"))


@check("match_mentions_partial", "mentions articles", MATCHES + "SELECT * FROM partial")
def _(spark, d):
    return mentions.match_partial(_counts(spark, d), view(spark, d, "articles"))


@check("mention_funnel", "mentions articles", MATCHES + f"""
SELECT count(*) AS fetched, count(*) FILTER (WHERE {ON_PLATFORM}) AS platform,
  count(*) FILTER (WHERE {ON_PLATFORM} AND {FOREIGN}) AS not_own,
  count(*) FILTER (WHERE {ON_PLATFORM} AND {FOREIGN} AND {IN_CONTEXT}) AS with_context,
  (SELECT count(*) FROM counts) AS urls_found, (SELECT count(*) FROM matches) AS matched FROM mentions""")
def _(spark, d):
    return mentions.mention_funnel(view(spark, d, "mentions"), view(spark, d, "articles"), BRAND)


