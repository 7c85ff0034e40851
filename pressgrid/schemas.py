"""Declared tables. Every field is nullable; NULL means "not computed yet"."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

STRING_FIELDS = [
    "url", "title", "domain", "country", "content", "matched_spokespeople", "matched_vc_investors",
    "matched_dealroom_rank", "matched_reporter", "matched_portcos", "language",
    "matched_portco_location", "matched_portco_deal_lead", "matched_portco_ai", "managed_by_fund",
    "tier", "kill_pill_context", "unwanted_context", "cleaned_url", "summary", "li_summary",
    "wa_summary", "text_scrape_error", "matched_vehicle",
]
BOOLEAN_FIELDS = [
    "spokespeople_in_headline", "tagged_brand", "kill_pill", "unwanted", "brand_in_headline",
    "tagged_portco", "unbranded_win", "text_scraped", "data_ingestion", "is_complete",
]
LONG_FIELDS = ["id", "page_rank", "kill_pill_count", "unwanted_count", "social_shares_count", "social_followers"]
DOUBLE_FIELDS = ["backlinks"]
TIMESTAMP_FIELDS = ["updated_at", "text_scraped_at", "ingestion_date", "scrape_date"]
DATE_FIELDS = ["publish_date", "month"]

ARTICLES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in STRING_FIELDS]
    + [T.StructField(n, T.BooleanType()) for n in BOOLEAN_FIELDS]
    + [T.StructField(n, T.LongType()) for n in LONG_FIELDS if n != "id"]
    + [T.StructField(n, T.DoubleType()) for n in DOUBLE_FIELDS]
    + [T.StructField(n, T.TimestampType()) for n in TIMESTAMP_FIELDS]
    + [T.StructField(n, T.DateType()) for n in DATE_FIELDS]
)

QUEUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("batch_name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.LongType()),
])
QUEUE_STATES = ["pending", "processing", "completed", "failed"]

STEP_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("proc", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("ms_elapsed", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

MENTION_FEED = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("author", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("url", T.StringType()),
        ])),
    ]))),
])

# The fields an article needs to count as complete, with the
# reported type and whether '' counts as missing.
REQUIRED_FIELDS = [
    ("id", "INT", False), ("publish_date", "DATE", False), ("url", "STRING", True),
    ("domain", "STRING", True), ("country", "STRING", False), ("content", "STRING", True),
    ("matched_spokespeople", "STRING", False), ("matched_vc_investors", "STRING", False),
    ("matched_portcos", "STRING", False), ("tagged_brand", "BOOL", False),
    ("language", "STRING", False), ("managed_by_fund", "STRING", False), ("kill_pill", "BOOL", False),
    ("kill_pill_context", "STRING", False), ("kill_pill_count", "INT", False),
    ("unwanted", "BOOL", False), ("unwanted_context", "STRING", False),
    ("unwanted_count", "INT", False), ("month", "STRING", False), ("tagged_portco", "BOOL", False),
    ("matched_vehicle", "STRING", False),
]


def conform(df: DataFrame, schema: T.StructType = ARTICLES) -> DataFrame:
    """Exactly the declared columns, in order and type; absent ones become NULL."""
    present = set(df.columns)
    return df.selectExpr(*[
        f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])
