"""Delimited exports, URL lists and mention feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.functions.urls import strip
from pressgrid.schemas import MENTION_FEED

SEPARATORS = [",", ";", "\t", "|"]

# Header spellings per field (lower case); the file's first fitting column is taken.
HEADERS = {
    "url": ["url"],
    "headline": ["headline", "title"],
    "publish_date": ["publish date", "date", "publish_date"],
    "publication": ["publication name", "domain", "publication"],
    "brand": ["brand", "content"],
}
# Cell texts that mean "missing" in an export.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The candidate that occurs most in the first lines."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(5).collect())
    return max(SEPARATORS, key=head.count)


def read_delimited(
    spark: SparkSession, path: str, headers: dict[str, list[str]] | None = None, multi_line: bool = False,
    required: str | None = "url",
) -> DataFrame:
    """An export as `pos` plus the fields of `headers`; absent columns are NULL.

    `pos` grows in input order. Big files are split over many tasks; with
    multi_line=True cells may hold line breaks, and each file is one task.
    """
    raw = (
        spark.read.option("header", True).option("sep", sniff_separator(spark, path)).option("quote", '"')
        .option("escape", '"').option("multiLine", multi_line).option("encoding", "UTF-8").csv(path)
    )
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    picked = {}
    for field, names in (headers or HEADERS).items():
        picked[field] = next((c for c in raw.columns if c.lower() in names), None)
    if required and picked[required] is None:
        raise ValueError(f"no {required} column among: {', '.join(raw.columns)}")
    cells = []
    for field, column in picked.items():
        if column is None:
            cells.append(F.lit(None).cast("string").alias(field))
        else:
            cell = F.col(f"`{column}`")
            cells.append(F.when(~F.coalesce(cell.isin(MISSING), F.lit(True)), strip(cell)).alias(field))
    return raw.select(F.monotonically_increasing_id().alias("pos"), *cells)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines are dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).filter(F.length("url") > 0)


def read_mention_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The items of feed documents, one document a line (or a file, with multi_line=True), author flattened."""
    feed = spark.read.schema(MENTION_FEED).option("multiLine", multi_line).json(path)
    item = feed.select(F.explode("items").alias("i"))
    return item.select(
        "i.url", "i.title", "i.summary", F.col("i.author.name").alias("author_name"),
        F.col("i.author.url").alias("author_url"))
