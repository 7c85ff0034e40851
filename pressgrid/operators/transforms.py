"""Inserts, updates and deletes as table-to-table functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import schemas
from pressgrid.functions.dates import month_start, parse_date
from pressgrid.functions.text import blank_to_null, mentions_brand
from pressgrid.functions.urls import cleaned_url_keep_scheme, normalize_url
from pressgrid.operators.grams import contained
from pressgrid.operators.joins import existing_urls
from pressgrid.operators.lookup import lookup
from pressgrid.operators.ordering import assign_ids, first_seen
from pressgrid.session import settle

SCRAPE_MIN = 50
ERROR_LIMIT = 500

# What a record gets where a field is absent on the way in.
RECORD_TEXT = [
    "url", "content", "domain", "title", "matched_spokespeople", "matched_reporter", "matched_portcos",
    "matched_vc_investors", "matched_vehicle", "managed_by_fund", "country", "language", "kill_pill_context",
    "unwanted_context",
]
RECORD_FLAGS = ["tagged_brand", "tagged_portco", "unbranded_win", "kill_pill", "unwanted"]
RECORD_COUNTS = ["kill_pill_count", "unwanted_count"]


def _or_default(df: DataFrame, name: str, default) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    return F.coalesce(value, F.lit(default)).alias(name)


def prepare_record(records: DataFrame, as_of: Column) -> DataFrame:
    """Incoming records with every field present and no NULL but the date."""
    return records.select(
        *[_or_default(records, c, "") for c in RECORD_TEXT],
        F.trim(F.col("publish_date").cast("string")).alias("publish_date"),
        as_of.alias("updated_at"),
        *[_or_default(records, c, False) for c in RECORD_FLAGS],
        *[_or_default(records, c, 0).cast("long").alias(c) for c in RECORD_COUNTS],
    )


def insert_if_absent(records: DataFrame, articles: DataFrame, as_of: Column, pos: str = "pos") -> DataFrame:
    """The table plus the records whose normalised URL it lacks, numbered on from its largest id."""
    normal = records.withColumn("url", normalize_url(F.col("url")))
    fresh = existing_urls(first_seen(normal, "url", pos), articles, "left_anti")
    added = assign_ids(fresh, articles, F.col(pos), by=[pos]).drop(pos)
    added = added.withColumns({"updated_at": as_of, "data_ingestion": F.lit(True)})
    return articles.unionByName(added, allowMissingColumns=True).select(*articles.columns)


def needs_fill() -> Column:
    """The rows a partial fill touches."""
    return reduce(or_, [F.col(c).isNull() for c in (
        "country", "tier", "language", "kill_pill", "month", "matched_portcos", "matched_vehicle")])


NOT_FILLED = ["url", "wa_summary", "matched_portco_ai"]
FILLED_COUNTS = ["page_rank", "kill_pill_count", "unwanted_count", "social_shares_count"]


def fill_defaults(articles: DataFrame, as_of: Column, only: Column | None = None) -> DataFrame:
    """The no-NULL convention: '' / FALSE / 0 / epoch, month from the date, cleaned URL from the URL.

    `only` restricts the fill to some rows (see `needs_fill`); all rows without it.
    """
    defaults: dict[str, Column] = {
        "month": F.coalesce("month", month_start(F.col("publish_date"), as_of)),
        "cleaned_url": F.coalesce("cleaned_url", cleaned_url_keep_scheme(F.col("url"))),
    }
    for c in schemas.STRING_FIELDS:
        if c not in defaults and c not in NOT_FILLED:
            defaults[c] = F.expr(f"coalesce({c}, '')")
    defaults.update({c: F.expr(f"coalesce({c}, false)") for c in schemas.BOOLEAN_FIELDS})
    defaults.update({c: F.expr(f"coalesce({c}, 0L)") for c in FILLED_COUNTS})
    defaults["backlinks"] = F.expr("coalesce(backlinks, 0.0D)")
    for c in ("text_scraped_at", "ingestion_date", "scrape_date"):
        defaults[c] = F.expr(f"coalesce({c}, TIMESTAMP '1970-01-01 00:00:00')")
    if only is not None:
        defaults = {c: F.when(only, v).otherwise(F.col(c)) for c, v in defaults.items()}
    return articles.withColumns(defaults)


def fill_language(articles: DataFrame, default: str = "en") -> DataFrame:
    due = (F.col("language") == "") & (F.col("content") != "")
    return articles.withColumn("language", F.when(due, F.lit(default)).otherwise(F.col("language")))


def flag_brand_headline(articles: DataFrame, brand: str) -> DataFrame:
    return articles.withColumn(
        "brand_in_headline",
        F.when(F.col("title") != "", mentions_brand(brand, F.col("title"))).otherwise(F.col("brand_in_headline")))


def last_per_key(updates: DataFrame, key: str) -> DataFrame:
    """One update per key: the last by `seq`, `pos` or `updated_at` where there are such columns, then by the other values."""
    rest = [c for c in updates.columns if c != key]
    order = [c for c in ("seq", "pos", "updated_at") if c in rest]
    order += [c for c in rest if c not in order]
    if not order:
        return updates.select(key).filter(F.col(key).isNotNull()).distinct()
    last = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("_u"))
    return last.select(key, *[F.col(f"_u.{c}").alias(c) for c in rest])


def _put(articles: DataFrame, updates: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Left join of the last update per key; `values` use the update's columns as `new_<name>`. No row is added."""
    updates = last_per_key(updates, key)
    renamed = updates.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in updates.columns if c != key],
                             F.lit(True).alias("_hit"))
    spread = [c for c in ("id", "url", "updated_at") if c in articles.columns and c != key]
    joined = lookup(articles, renamed, key, spread=spread)
    return joined.withColumns(
        {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*articles.columns)


def update_content(articles: DataFrame, updates: DataFrame, as_of: Column, precedence: str = "old") -> DataFrame:
    """New bodies by id. Title and date: 'old' keeps a filled one, 'new' prefers a filled new title, 'overwrite' replaces."""
    values = {"content": F.col("new_content"), "updated_at": as_of}
    if precedence == "old":
        values = {
            "content": F.col("new_content"),
            "title": F.coalesce(blank_to_null(F.col("title")), F.col("new_title")),
            "publish_date": F.coalesce("publish_date", parse_date(F.col("new_publish_date"), ["yyyy-MM-dd"]).cast("date")),
            "scrape_date": as_of, "data_ingestion": F.lit(False),
        }
    elif precedence == "new":
        values["title"] = F.coalesce(blank_to_null(F.col("new_title")), F.col("title"))
    elif precedence == "overwrite":
        values.update(title=F.col("new_title"), domain=F.col("new_domain"))
    else:
        raise ValueError(f"precedence must be 'old', 'new' or 'overwrite', not {precedence!r}")
    return _put(articles, updates, "id", values)


def apply_scrape_result(articles: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Fetched bodies by URL: a usable one is stored, any other outcome leaves an error text.

    `results`: url, content, error; one row per URL.
    """
    usable = F.coalesce(F.length(F.trim("new_content")) > SCRAPE_MIN, F.lit(False))
    error = F.substr(F.coalesce("new_error", F.lit("Content extraction failed")), F.lit(1), F.lit(ERROR_LIMIT))
    return _put(articles, results, "url", {
        "content": F.when(usable, F.col("new_content")).otherwise(F.col("content")),
        "text_scraped": usable | F.coalesce("text_scraped", F.lit(False)),
        "text_scraped_at": F.when(usable, as_of).otherwise(F.col("text_scraped_at")),
        "text_scrape_error": F.when(usable, F.lit(None)).otherwise(error),
        "updated_at": as_of,
    })


EDITABLE = ["matched_portcos", "matched_spokespeople", "content"]


def edit_rows(articles: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    """Edited rows by id; only real differences count as a change."""
    changed = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in EDITABLE])
    values = {c: F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in EDITABLE}
    values["updated_at"] = F.when(changed, as_of).otherwise(F.col("updated_at"))
    return _put(articles, edits.select("id", *EDITABLE), "id", values)


def bulk_set(articles: DataFrame, ids: DataFrame, column: str, value) -> DataFrame:
    """One column set to one value for a set of ids."""
    return _put(articles, ids.select("id").distinct(), "id", {column: F.lit(value)})


def _without(articles: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    spread = [c for c in ("id", "updated_at") if c in articles.columns]
    return lookup(articles, keys, key, "left_anti", spread=spread or None).select(*articles.columns)


def delete_by_url(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows whose stored URL equals none of the normalised URLs."""
    doomed = urls.select(normalize_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    return _without(articles, doomed, "url")


def count_deleted(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """How many rows `delete_by_url` removes."""
    doomed = urls.select(normalize_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    # copies are counted map-side, so a hot URL is one row per task
    copies = articles.groupBy("url").agg(F.count("*").alias("n"))
    return copies.join(doomed, "url", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted"))


def count_deleted_by_pattern(articles: DataFrame, patterns: DataFrame) -> DataFrame:
    """How many rows `delete_by_pattern` removes."""
    copies = articles.groupBy("url").agg(F.count("*").alias("n"))
    left = delete_by_pattern(copies, patterns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left"))
    return copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select((F.col("n") - left.scalar()).alias("deleted"))


def delete_by_pattern(articles: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows matching none of the shortened URLs, where '...' stands for anything (and _ for one character).

    A pattern is filed under the rarest run of characters of its longest fixed part, wherever that
    stands in it, and URLs that hold the run are tested in full; so any number of patterns of
    any form is fine. Patterns without a fixed part speak of lengths only: one number for those with '...',
    and at most one per length for the others.
    """
    wild = patterns.filter("url IS NOT NULL").select(F.replace("url", F.lit("..."), F.lit("%")).alias("_like")).distinct()
    longest = F.aggregate(F.split("_like", "[%_]"), F.lit(""), lambda best, part: F.when(
        F.length(part) > F.length(best), part).otherwise(best))
    wild = settle(wild.withColumn("_part", longest))
    other = wild.filter(F.col("_like") != F.col("_part"))
    urls = articles.select("url").filter(F.col("url").isNotNull()).distinct()
    matches = F.expr(r"url LIKE _like ESCAPE '\u0001'")  # a backslash stands for itself
    doomed = wild.filter(F.col("_like") == F.col("_part")).select(F.col("_like").alias("url")).unionByName(
        contained(urls, "url", other, "_part").filter(matches).select("url"))
    # nothing but wildcards: so many characters, or at least so many
    bare = other.filter(F.col("_part") == "")
    count, open_ = F.length(F.replace("_like", F.lit("%"), F.lit(""))), F.col("_like").contains("%")
    sizes = bare.agg(F.min(F.when(open_, count)).alias("least"), F.collect_set(F.when(~open_, count)).alias("sizes")).first()
    if sizes["least"] is not None or sizes["sizes"]:
        long = F.lit(False) if sizes["least"] is None else F.length("url") >= sizes["least"]
        doomed = doomed.unionByName(urls.filter(long | F.length("url").isin(sizes["sizes"])))
    return _without(articles, doomed.distinct(), "url")


def delete_null_ids(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("id").isNotNull())


def delete_false_entries(articles: DataFrame, low: int, high: int, test_domain: str) -> DataFrame:
    """Without rows lacking an id, in an id range or of the test domain."""
    false = F.col("id").isNull() | F.col("id").between(low, high) | (F.col("domain") == test_domain)
    return articles.filter(~F.coalesce(false, F.lit(False)))


def ingest_row_build(rows: DataFrame, brand: str, as_of: Column) -> DataFrame:
    """Article rows from intake rows (url, headline, publish_date, brand) and extracted page fields
    (page_title, page_date, page_domain, page_content). The intake's headline and date win."""
    given = F.coalesce("brand", F.lit(""))
    title = F.coalesce(blank_to_null(F.col("headline")), F.col("page_title"), F.lit(""))
    content = F.coalesce("page_content", F.lit(""))
    built = rows.select(
        *[c for c in ("pos", "id") if c in rows.columns],
        "url", title.alias("title"),
        F.coalesce(parse_date(F.col("publish_date")).cast("date"), F.col("page_date")).alias("publish_date"),
        F.coalesce("page_domain", F.lit("")).alias("domain"), content.alias("content"),
        as_of.alias("updated_at"), F.lit(True).alias("data_ingestion"),
        mentions_brand(brand, given, content, title).alias("tagged_brand"),
        F.when(F.lower(given) != brand.lower(), given).otherwise("").alias("matched_portcos"),
        F.element_at(F.split(F.element_at(F.split("url", r"\?"), 1), "#"), 1).alias("cleaned_url"),
    )
    return built


def add_company(companies: DataFrame, new: DataFrame, as_of: Column, pos: str = "pos") -> DataFrame:
    """Dictionary plus new companies (name, location, deal_lead, vehicle), trimmed, with the next ids."""
    def known(c: str) -> Column:
        return F.coalesce(blank_to_null(F.trim(c)), F.lit("Unknown"))

    named = new.filter(F.trim("name") != "")
    rows = assign_ids(named, companies, F.col(pos), by=[pos]).select(
        "id", as_of.alias("created_at"), F.trim("name").alias("portco_name"), known("location").alias("portco_location"),
        known("deal_lead").alias("portco_deal_lead"), F.lit("false").alias("ai"),
        F.substr(F.sha2(F.concat_ws("|", F.trim("name"), "id"), 256), F.lit(1), F.lit(8)).alias("sync_key"),
        blank_to_null(F.trim("vehicle")).alias("vehicle"))
    return companies.unionByName(rows, allowMissingColumns=True)
