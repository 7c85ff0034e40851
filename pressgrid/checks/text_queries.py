"""URL forms, text expressions, validation and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressgrid.checks.registry import check, latest, load
from pressgrid.checks.views import BRAND, FAMILY_ONE, FAMILY_TWO, view
from pressgrid.functions import dates, pages, text, urls, validation
from pressgrid.operators.audit import log_context
from pressgrid.operators.domains import derive_tier
from pressgrid.operators.mentions import context_words, noise_words, relevant_mentions
from pressgrid.operators.views import route_paywalled

WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def norm_sql(c: str) -> str:
    """The storage form of a URL."""
    s = f"trim({c}, {WHITE})"
    s = f"CASE WHEN {s} LIKE '/_%' THEN substr({s}, 2) ELSE {s} END"
    s = f"(CASE WHEN regexp_matches({s}, '^https?://') THEN {s} ELSE 'https://' || {s} END)"
    s = f"(CASE WHEN length({s}) - length(replace({s}, '/', '')) > 2 THEN rtrim({s}, '/') ELSE {s} END)"
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN {c} ELSE replace({s}, '://www.', '://') END"


def match_sql(c: str) -> str:
    """The matching form of a URL."""
    cut = f"rtrim(split_part(split_part({c}, '?', 1), '#', 1), '/')"
    return f"coalesce(lower(replace(replace({cut}, 'http://', 'https://'), 'www.', '')), '')"


def clean_sql(c: str) -> str:
    s = f"regexp_replace(lower(trim({c})), '^https?://(www\\.)?', '')"
    return f"regexp_replace(regexp_replace({s}, '\\?.*$', ''), '/$', '')"


def keep_scheme_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\?.*', ''), '#.*', '')"


def host_sql(c: str) -> str:
    host = f"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    return f"regexp_replace({host}, '^www\\.', '')"


def known_domain_sql(domain: str, url: str) -> str:
    host = f"nullif(regexp_extract(lower(trim({url})), '^https?://(?:www\\.)?([^/]+)', 1), '')"
    return f"coalesce(lower(nullif(trim({domain}), '')), {host})"


def words_re(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def context_sql(content: str, words: list[str]) -> str:
    hits = (f"list_filter(string_split(coalesce({content}, ''), '.'), "
            f"lambda s: regexp_matches(lower(s), '{words_re(words)}'))")
    return f"nullif(array_to_string({hits}, ' | '), '')"


def family_sql(content: str, prefix: str, words: list[str]) -> str:
    low = f"lower(coalesce({content}, ''))"
    return (f"regexp_matches({low}, '{words_re(words)}') AS {prefix}, "
            f"CAST(len(regexp_extract_all({low}, '{words_re(words)}')) AS BIGINT) AS {prefix}_count, "
            f"{context_sql(content, words)} AS {prefix}_context")


def word_sql(c: str, word: str) -> str:
    return rf"regexp_matches(lower(coalesce({c}, '')), '\b{word}\b')"


@check("normalize_url", "submitted articles", f"""
SELECT pos, url, {norm_sql('url')} AS norm FROM submitted
UNION ALL SELECT -1, url, {norm_sql('url')} FROM articles""")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    both = submitted.select("pos", "url").unionByName(articles.select(F.lit(-1).cast("long").alias("pos"), "url"))
    return both.withColumn("norm", urls.normalize_url(F.col("url")))


@check("normalize_url_match", "submitted articles", f"""
SELECT pos, url, {match_sql('url')} AS norm FROM submitted
UNION ALL SELECT -1, url, {match_sql('url')} FROM articles""")
def _(spark, d):
    submitted, articles = load(spark, d, "submitted", "articles")
    both = submitted.select("pos", "url").unionByName(articles.select(F.lit(-1).cast("long").alias("pos"), "url"))
    return both.withColumn("norm", urls.match_url(F.col("url")))


@check("cleaned_url", "articles", f"SELECT updated_at, {clean_sql('url')} AS cleaned FROM articles", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select("updated_at", urls.cleaned_url(F.col("url")).alias("cleaned"))


@check("cleaned_url_keep_scheme", "articles", f"SELECT updated_at, {keep_scheme_sql('url')} AS cleaned FROM articles", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select("updated_at", urls.cleaned_url_keep_scheme(F.col("url")).alias("cleaned"))


@check("domain_from_url", "articles", f"""
SELECT updated_at, {host_sql('url')} AS host, {known_domain_sql('domain', 'url')} AS known FROM articles
UNION ALL SELECT NULL, {host_sql('url')}, {known_domain_sql("''", 'url')} FROM pages""", text="updated_at")
def _(spark, d):
    articles, sources = load(spark, d, "articles", "pages")
    url = F.col("url")
    return articles.select(
        "updated_at", urls.domain_from_url(url).alias("host"), urls.known_domain(F.col("domain"), url).alias("known"),
    ).unionByName(sources.select(
        F.lit(None).cast("timestamp").alias("updated_at"), urls.domain_from_url(url).alias("host"),
        urls.known_domain(F.lit(""), url).alias("known")))


@check("normalize_domain", "articles", "SELECT updated_at, lower(replace(domain, 'www.', '')) AS norm FROM articles", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select("updated_at", urls.normalize_domain(F.col("domain")).alias("norm"))


@check("month_trunc", "articles", """
SELECT updated_at, CAST(date_trunc('month', CAST(coalesce(publish_date, (SELECT CAST(max(updated_at) AS DATE) FROM articles)) AS DATE)) AS DATE) AS month
FROM articles""", text="updated_at month")
def _(spark, d):
    articles = view(spark, d, "articles")
    return articles.select("updated_at", dates.month_start(F.col("publish_date"), latest(articles)).alias("month"))


@check("detect_language", "articles", r"""
SELECT updated_at, coalesce(language, CASE WHEN regexp_matches(coalesce(content, ''), '\p{Han}') THEN 'zh' ELSE 'en' END) AS language
FROM articles""", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select(
        "updated_at", text.detect_language(F.col("content"), F.col("language")).alias("language"))


TAGGED = f"({word_sql('content', BRAND)} OR {word_sql('title', BRAND)} OR lower(coalesce(managed_by_fund, '')) = '{BRAND}')"


@check("tag_brand", "tracked", f"""
SELECT updated_at, {TAGGED} AS recomputed, coalesce(tagged_brand, {TAGGED}) AS kept, {word_sql('title', BRAND)} AS in_headline
FROM tracked""", text="updated_at")
def _(spark, d):
    title, content, fund = F.col("title"), F.col("content"), F.col("managed_by_fund")
    return view(spark, d, "tracked").select(
        "updated_at", text.tag_brand(title, content, fund, BRAND).alias("recomputed"),
        text.tag_brand(title, content, fund, BRAND, current=F.col("tagged_brand")).alias("kept"),
        text.has_word(title, [BRAND]).alias("in_headline"))


@check("tag_brand_substring", "articles", """
SELECT updated_at, coalesce(content, '') ILIKE '%hbl%' OR coalesce(title, '') ILIKE '%hbl%' AS tagged FROM articles""", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select(
        "updated_at", text.mentions_brand("hbl", F.col("content"), F.col("title")).alias("tagged"))


@check("keyword_flags", "articles", f"""
SELECT updated_at, {family_sql('content', 'kill_pill', FAMILY_ONE)}, {family_sql('content', 'unwanted', FAMILY_TWO)}
FROM articles""", text="updated_at")
def _(spark, d):
    content = F.col("content")
    flags = {**text.keyword_flags(content, "kill_pill", FAMILY_ONE), **text.keyword_flags(content, "unwanted", FAMILY_TWO)}
    return view(spark, d, "articles").select("updated_at", *[c.alias(n) for n, c in flags.items()])


@check("content_guard", "articles", """
SELECT updated_at, length(trim(coalesce(content, ''))) AS content_length, length(trim(coalesce(content, ''))) >= 20 AS passes,
  CASE WHEN length(trim(coalesce(content, ''))) < 20 THEN 'content too short (<20)' END AS message FROM articles""", text="updated_at")
def _(spark, d):
    content = F.col("content")
    return view(spark, d, "articles").select(
        "updated_at", F.length(F.trim(F.coalesce(content, F.lit("")))).cast("long").alias("content_length"),
        text.passes_guard(content).alias("passes"),
        F.when(~text.passes_guard(content), f"content too short (<{text.GUARD_LENGTH})").alias("message"))


def _cut_sql(s: str, limit: int, floor: int) -> str:
    def last(mark: str) -> str:
        found = f"instr(reverse(substr({s}, 1, {limit})), '{mark[::-1]}')"
        return f"(CASE WHEN {found} > 0 THEN {limit} - {found} - 1 ELSE -1 END)"
    cuts = " ".join(f"WHEN {last(m)} > {floor} THEN {last(m)} + 1" for m in (". ", "! ", "? "))
    return f"CASE WHEN length({s}) > {limit} THEN substr({s}, 1, CASE {cuts} ELSE {limit} END) ELSE {s} END"


def snippet_sql(source: str, key: str, content: str, words: list[str]) -> str:
    """WITH members that walk the hits of each text one at a time; the last one is `snippet`."""
    hit = " OR ".join(f"contains(lower(x), '{w}')" for w in words)
    return f"""
, sents AS (SELECT {key} AS k, {content} AS t,
    string_split(regexp_replace({content}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM {source})
, hits AS (SELECT k, s, list_filter(list_transform(s, lambda x, i: CASE WHEN {hit} THEN i ELSE 0 END), lambda i: i > 0) AS h FROM sents WHERE t <> '')
, walk AS (
  WITH RECURSIVE w(k, n, kept) AS (
    SELECT k, CAST(1 AS BIGINT), CAST([] AS VARCHAR[]) FROM hits WHERE len(h) > 0
    UNION ALL
    SELECT w.k, w.n + 1, CASE WHEN h[n] < len(s) AND len(lead) < 5 THEN list_append(lead, s[h[n] + 1]) ELSE lead END
    FROM (SELECT w.k, w.n, hits.h, hits.s, list_append(
            CASE WHEN h[w.n] > 1 AND NOT list_contains(w.kept, s[h[w.n] - 1]) THEN list_append(w.kept, s[h[w.n] - 1]) ELSE w.kept END,
            s[h[w.n]]) AS lead
          FROM w JOIN hits ON w.k = hits.k WHERE w.n <= len(hits.h) AND len(w.kept) < 5) AS w)
  SELECT k, arg_max(kept, n) AS kept FROM w GROUP BY k)
, joined AS (SELECT sents.k, t, array_to_string(walk.kept, ' ') AS a, array_to_string(s[1:3], ' ') AS b
  FROM sents LEFT JOIN walk ON sents.k = walk.k)
, snippet AS (SELECT k, CASE WHEN t IS NULL OR t = '' THEN '' WHEN a IS NOT NULL THEN {_cut_sql('a', 500, 200)}
  ELSE {_cut_sql('b', 300, 100)} END AS snippet FROM joined)
"""


@check("key_sentence_snippet", "articles", f"""{snippet_sql('articles', 'updated_at', 'content', ['thble', 'attion'])}
SELECT k AS updated_at, snippet FROM snippet""", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select(
        "updated_at", text.key_snippet(F.col("content"), [BRAND, "attion"]).alias("snippet"))


URL_RE = r"""https?://[^\s<>"{}|\\^`\[\]]+"""


@check("extract_urls", "mentions", f"""
SELECT conv_id, turn, unnest(regexp_extract_all(title || ' ' || summary, '{URL_RE}')) AS found FROM mentions""")
def _(spark, d):
    both = F.concat("title", F.lit(" "), "summary")
    return view(spark, d, "mentions").select("conv_id", "turn", F.explode(urls.extract_urls(both)).alias("found"))


SOCIAL = "|".join(s.replace(".", r"\.") for s in urls.SOCIAL_SITES)


@check("article_url_filter", "mentions", f"""
, u AS (SELECT conv_id, turn, unnest(regexp_extract_all(title || ' ' || summary, '{URL_RE}')) AS found FROM mentions
  UNION ALL SELECT conv_id, turn, url FROM mentions)
SELECT conv_id, turn, found FROM u WHERE NOT regexp_matches(lower(found), '{SOCIAL}')""")
def _(spark, d):
    both = F.concat("title", F.lit(" "), "summary")
    every = F.concat(urls.extract_urls(both), F.array("url"))
    rows = view(spark, d, "mentions").select("conv_id", "turn", F.explode(every).alias("found"))
    return rows.filter(urls.is_article_url(F.col("found")))


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


MENTION_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(summary, ''))"
ON_PLATFORM = "(contains(url, 'x.com') OR contains(url, 'twitter.com'))"
FOREIGN = f"(NOT contains(lower(author_name), '{BRAND}') AND NOT contains(lower(author_url), '{BRAND}'))"
IN_CONTEXT = f"(NOT {any_sql(MENTION_TEXT, noise_words(BRAND))} AND {any_sql(MENTION_TEXT, context_words(BRAND))})"
RELEVANT = f"{ON_PLATFORM} AND {FOREIGN} AND {IN_CONTEXT}"


@check("mention_context_filter", "mentions", f"SELECT conv_id, turn, url, title FROM mentions WHERE {RELEVANT}")
def _(spark, d):
    return relevant_mentions(view(spark, d, "mentions"), BRAND).select("conv_id", "turn", "url", "title")


@check("parse_dates", "bodies", """
SELECT id, CAST(try_strptime(publish_date, '%Y-%m-%d') AS TIMESTAMP) AS from_iso,
  CAST(try_strptime(CAST(10 + id % 25 AS VARCHAR) || ' Sep 2025', '%d %b %Y') AS TIMESTAMP) AS from_export
FROM bodies""", text="from_iso from_export")
def _(spark, d):
    export = F.concat((10 + F.col("id") % 25).cast("string"), F.lit(" Sep 2025"))
    return view(spark, d, "bodies").select(
        "id", dates.parse_date(F.col("publish_date")).alias("from_iso"), dates.parse_date(export).alias("from_export"))


@check("truncate_text", "articles", """
SELECT updated_at, CASE WHEN length(content) > 1000 THEN substr(content, 1, 1000) || '... [truncated]' ELSE content END AS capped,
  translate(substr(content, 1, 500), '"' || chr(10), ''' ') AS flat FROM articles""", text="updated_at")
def _(spark, d):
    content = F.col("content")
    return view(spark, d, "articles").select(
        "updated_at", text.truncate_text(content, 1000, "... [truncated]").alias("capped"),
        text.flatten_quotes(content, 500).alias("flat"))


@check("sanitize_text", "articles", f"""
SELECT updated_at, coalesce(translate(trim(content, {WHITE}), '<>"''', ''), '') AS clean FROM articles""", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select("updated_at", text.sanitize_text(F.col("content")).alias("clean"))


@check("derive_tier", "tracked", """
SELECT updated_at, page_rank, CASE WHEN page_rank < 5 THEN 'Tier 3' WHEN page_rank < 7 THEN 'Tier 2' WHEN page_rank >= 7 THEN 'Tier 1' END AS tier
FROM tracked""", text="updated_at page_rank")
def _(spark, d):
    return view(spark, d, "tracked").select("updated_at", "page_rank", derive_tier(F.col("page_rank")).alias("tier"))


@check("unbranded_win", "tracked", """
SELECT updated_at, coalesce(matched_portcos <> '', FALSE) AND NOT coalesce(brand_in_headline, FALSE) AS unbranded_win FROM tracked""", text="updated_at")
def _(spark, d):
    win = text.unbranded_win(F.col("matched_portcos"), F.col("brand_in_headline"))
    return view(spark, d, "tracked").select("updated_at", win.alias("unbranded_win"))


@check("validate_rows", "bodies", r"""
, r AS (SELECT id, title, domain, publish_date, 'user' || CAST(id AS VARCHAR) || CASE WHEN id % 6 = 0 THEN '.example' ELSE '@example.com' END AS email,
    CASE WHEN id % 10 = 0 THEN domain ELSE 'https://' || domain || '/' || CAST(id AS VARCHAR) END AS url,
    'https://a.example' || chr(10) || CASE WHEN id % 8 = 0 THEN 'nothing' ELSE 'http://b.example/x' END AS backlinks FROM bodies)
SELECT id, array_to_string(list_filter([
  CASE WHEN trim(title) = '' THEN 'Title is required' END, CASE WHEN trim(publish_date) = '' THEN 'Publish Date is required' END,
  CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+') THEN 'Invalid URL format' END,
  CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 'Invalid email format' END,
  CASE WHEN try_strptime(publish_date, '%Y-%m-%d') IS NULL THEN 'Invalid date format' END,
  CASE WHEN id % 8 = 0 THEN 'Line 2: Invalid URL format' END], lambda m: m IS NOT NULL), '; ') AS errors FROM r""")
def _(spark, d):
    i = F.col("id")
    rows = view(spark, d, "bodies").select(
        "id", "title", "publish_date",
        F.concat(F.lit("user"), i, F.when(i % 6 == 0, ".example").otherwise("@example.com")).alias("email"),
        F.when(i % 10 == 0, F.col("domain")).otherwise(F.concat(F.lit("https://"), "domain", F.lit("/"), i)).alias("url"),
        F.concat(F.lit("https://a.example\n"), F.when(i % 8 == 0, "nothing").otherwise("http://b.example/x")).alias("backlinks"))
    checked = validation.validate_rows(
        rows, ["title", "publish_date"], email="email", day="publish_date", backlinks="backlinks")
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))


@check("log_context", "articles", """
SELECT updated_at, '{"id":' || coalesce(CAST(id AS VARCHAR), 'null') || ',"domain":' || coalesce('"' || domain || '"', 'null') || '}' AS context
FROM articles""", text="updated_at")
def _(spark, d):
    return view(spark, d, "articles").select("updated_at", log_context("id", "domain").alias("context"))


# ---- pages

ENTITY_SQL = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]


def plain_sql(c: str) -> str:
    s = f"regexp_replace({c}, '<[^>]*>', '', 'gs')"
    for entity, char in ENTITY_SQL:
        s = f"replace({s}, '{entity}', '{char}')"
    return f"trim({s}, {WHITE})"


TITLE_SQL = (f"coalesce(nullif({plain_sql(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))}, ''), "
             f"nullif({plain_sql(chr(39).join(['regexp_extract(html, ', '(?is)<h1[^>]*>(.*?)</h1>', ', 1)']))}, ''))")
_ARTICLE_PART = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
_SOURCE = f"CASE WHEN regexp_matches({_ARTICLE_PART}, '(?i)<p[ >]') THEN {_ARTICLE_PART} ELSE html END"
_BLOCKS = rf"regexp_extract_all({_SOURCE}, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1)"
_BODY = f"array_to_string(list_filter(list_transform({_BLOCKS}, lambda p: {plain_sql('p')}), lambda p: length(p) > 20), chr(10) || chr(10))"
BODY_SQL = f"CASE WHEN length({_BODY}) >= 100 THEN {_BODY} END"
# no page of the given tables states a date: the processing date stands in
PROCESSED = "DATE '2025-01-31'"


def processed():
    return F.lit("2025-01-31").cast("timestamp")


@check("page_title", sql=f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def _(spark, d):
    return view(spark, d, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@check("page_publish_date", sql=f"""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<meta name="pubdate" content="2024-03-0' || CAST(page_id % 9 + 1 AS VARCHAR) || '">'
  WHEN 1 THEN '{{"datePublished": "never"}}<time datetime="2024-06-11">' WHEN 2 THEN '{{"datePublished": "2023-12-05T10:00:00"}}' ELSE '' END || html AS html FROM pages)
SELECT page_id, coalesce(CAST(nullif(regexp_extract(html, '"datePublished": "(2[^"]+)"', 1), '') AS DATE),
  CAST(nullif(regexp_extract(html, '<meta name="pubdate" content="([^"]+)"', 1), '') AS DATE),
  CAST(nullif(regexp_extract(html, '<time datetime="([^"]+)"', 1), '') AS DATE), {PROCESSED}) AS publish_date FROM p""", text="publish_date")
def _(spark, d):
    i = F.col("page_id") % 4
    place = F.when(i == 0, F.concat(F.lit('<meta name="pubdate" content="2024-03-0'), F.col("page_id") % 9 + 1, F.lit('">'))) \
        .when(i == 1, '{"datePublished": "never"}<time datetime="2024-06-11">') \
        .when(i == 2, '{"datePublished": "2023-12-05T10:00:00"}').otherwise("")
    return view(spark, d, "pages").select(
        "page_id", pages.page_publish_date(F.concat(place, F.col("html")), processed()).alias("publish_date"))


@check("page_body", sql=f"SELECT page_id, {BODY_SQL} AS body FROM pages")
def _(spark, d):
    return view(spark, d, "pages").select("page_id", pages.page_body(F.col("html")).alias("body"))


@check("page_modes", sql=f"""
WITH p AS (SELECT page_id, url, {TITLE_SQL} AS t, {BODY_SQL} AS body FROM pages)
{snippet_sql('p', 'page_id', 'body', ['thble', 'attion'])}
SELECT page_id, url, {host_sql('url')} AS domain, mode, {PROCESSED} AS publish_date,
  CASE mode WHEN 'full' THEN substr(body, 1, 50000) WHEN 'light' THEN snippet END AS content,
  CASE mode WHEN 'metadata' THEN coalesce(t, 'No title') WHEN 'full' THEN coalesce(t, string_split(body, chr(10))[1])
    ELSE coalesce(t, CASE WHEN length(snippet) > 100 THEN substr(snippet, 1, 100) || '...' ELSE nullif(snippet, '') END) END AS title
FROM p JOIN snippet ON p.page_id = snippet.k, (VALUES ('metadata'), ('light'), ('full')) AS m(mode)""", text="publish_date")
def _(spark, d):
    source = view(spark, d, "pages")
    parts = [pages.extract_pages(source, m, processed(), [BRAND, "attion"]).withColumn("mode", F.lit(m))
             for m in ("metadata", "light", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("short_content_fallback", "bodies", f"""
, p AS (SELECT page_id, {BODY_SQL} AS body FROM pages)
SELECT page_id, CASE WHEN length(coalesce(first_body, '')) < 100 AND length(b.content) > length(coalesce(first_body, '')) THEN b.content ELSE first_body END AS content
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(body, 1, 60) WHEN page_id % 3 = 1 THEN body END AS first_body FROM p)
LEFT JOIN bodies b ON page_id = b.id""")
def _(spark, d):
    source, bodies = load(spark, d, "pages", "bodies")
    i = F.col("page_id") % 3
    body = pages.page_body(F.col("html"))
    first = source.select("page_id", F.when(i == 0, F.substr(body, F.lit(1), F.lit(60))).when(i == 1, body).alias("first_body"))
    return first.join(bodies.select(F.col("id").alias("page_id"), "content"), "page_id", "left").select(
        "page_id", pages.prefer_longer(F.col("first_body"), F.col("content")).alias("content"))


_MARKDOWN = f"""
, b AS (SELECT page_id, coalesce({TITLE_SQL}, '') AS t, coalesce({BODY_SQL}, '') AS body FROM pages)
, m AS (SELECT page_id, t || chr(10) || '- [News](/n)' || chr(10) || '![logo](x)' || chr(10) || '# ' || t || chr(10) || chr(10) || chr(10) || chr(10)
    || '[Home](http://a.example)' || chr(10) || body || chr(10) || 'see [the source](http://b.example/x) here' || chr(10)
    || CASE WHEN page_id % 2 = 0 THEN '## Stay ahead in Asia' || chr(10) || 'after the end' ELSE '3 min read' END AS md FROM b)
"""


@check("strip_page_chrome", sql="WITH" + _MARKDOWN.strip()[1:] + f"""
SELECT page_id, trim(regexp_replace(
    '# ' || trim(t, {WHITE}) || chr(10) || chr(10) || array_to_string(list_filter(string_split(body, chr(10)), lambda l: NOT (l LIKE '%Featured%' OR l LIKE '%min read%' OR l LIKE '%- More%' OR l LIKE '%anywhere else%')), chr(10))
    || chr(10) || 'see the source here', chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), {WHITE}) AS article
FROM b""")
def _(spark, d):
    nl = F.lit("\n")
    title = F.coalesce(pages.page_title(F.col("html")), F.lit(""))
    body = F.coalesce(pages.page_body(F.col("html")), F.lit(""))
    end = F.when(F.col("page_id") % 2 == 0, "## Stay ahead in Asia\nafter the end").otherwise("3 min read")
    markdown = F.concat(
        title, nl, F.lit("- [News](/n)"), nl, F.lit("![logo](x)"), nl, F.lit("# "), title, nl, nl, nl, nl,
        F.lit("[Home](http://a.example)"), nl, body, nl, F.lit("see [the source](http://b.example/x) here"), nl, end)
    return view(spark, d, "pages").select("page_id", pages.strip_page_chrome(markdown).alias("article"))


PAYWALL = "|".join(s.replace(".", r"\.") for s in urls.PAYWALLED_SITES)


@check("route_paywalled", sql=f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '.example.com', '.ft.com') ELSE url END AS url FROM pages)
SELECT page_id, url, CASE WHEN regexp_matches({host_sql('url')}, '{PAYWALL}') THEN 'paywalled' ELSE 'standard' END AS route FROM p""")
def _(spark, d):
    moved = F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit(".example.com"), F.lit(".ft.com"))).otherwise(F.col("url"))
    return route_paywalled(view(spark, d, "pages").select("page_id", moved.alias("url")))
