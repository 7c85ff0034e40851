"""Substring search that opens only the blocks of a stored table that can hold the term.

Rows are stored by month and block, neighbours by domain and URL together. For
every run of three characters the postings name the blocks it occurs in, in lower case. A search
looks up the term's runs, opens the blocks that have all of them, and tests their rows in full.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.operators.views import SEARCH_FIELDS, search_articles

RUN, SHELVES, BLOCK_ROWS = 3, 64, 200_000
_BREAK = "\x01"  # parts the fields of a row; a run never counts across it, because no term holds it


def index_months(articles: DataFrame, path: str, month: str = "month", block_rows: int = BLOCK_ROWS) -> None:
    """Store the rows and postings of exactly the months that `articles` holds; other months stay as they are.

    Blocks have about `block_rows` rows of one month. A range partition is a block, so
    a month or a domain with a third of all rows has many.
    """
    spark = articles.sparkSession
    blocks = max(1, -(-articles.count() // block_rows))
    rows = articles.withColumn("_month", F.coalesce(F.date_format(month, "'m'yyyyMM"), F.lit("none")))
    placed = rows.repartitionByRange(blocks, F.col("_month"), F.col("domain"), F.col("url"), F.col("id")).withColumn("_block", F.spark_partition_id())
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_month", "_block").parquet(f"{path}/rows")
    # postings are taken from what was stored, so both agree whatever a retry did
    months = [r[0] for r in rows.select("_month").distinct().collect()]  # one per month
    stored = spark.read.schema(_stored_schema(articles)).parquet(f"{path}/rows").filter(F.col("_month").isin(months))
    text = F.lower(F.concat_ws(_BREAK, F.col("id").cast("string"), *SEARCH_FIELDS))
    # one pass over the text: a look-ahead gives the run at every place (substr would count from the beginning each time)
    runs = F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1))
    posted = (
        stored.select("_month", "_block", text.alias("_text")).filter(F.length("_text") >= RUN)
        .select("_month", "_block", F.explode(F.array_distinct(runs)).alias("run")).filter(~F.col("run").contains(_BREAK)).distinct()
        .withColumn("shelf", (F.crc32(F.col("run").cast("binary")) % SHELVES).cast("int"))
    )
    # one file per month and shelf, sorted, so that a run is found by the file's statistics
    posted.repartition("_month", "shelf").sortWithinPartitions("_month", "shelf", "run").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("_month", "shelf").parquet(f"{path}/postings")


def _stored_schema(articles: DataFrame):
    return articles.withColumns({"_month": F.lit(""), "_block": F.lit(0)}).schema


def runs_of(spark: SparkSession, term: str) -> list[str]:
    """The runs that a text must hold to match the pattern; wildcards part them."""
    pattern = f"%{term}%"
    low = pattern.lower() if pattern.isascii() else spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    return sorted({part[k : k + RUN] for part in re.split("[%_]", low) for k in range(len(part) - RUN + 1)})


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("_month", "_block")


def search_stored(spark: SparkSession, path: str, term: str, fields: list[str] | None = None) -> DataFrame:
    """The rows `search_articles` finds in the stored table, from the blocks that can hold the term.

    A term without three characters in a row between wildcards, or with an escape, is searched for in all rows,
    and so are fields the postings do not cover.
    """
    term = term.strip()
    covered = "\\" not in term and set(fields or SEARCH_FIELDS) <= set(SEARCH_FIELDS)
    runs = runs_of(spark, term) if covered else []
    whole = stored_rows(spark, path)
    if not runs:
        return search_articles(whole, term, fields)
    shelves = sorted({zlib.crc32(r.encode()) % SHELVES for r in runs})
    posted = spark.read.parquet(f"{path}/postings").filter(F.col("shelf").isin(shelves) & F.col("run").isin(runs))
    found = posted.groupBy("_month", "_block").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs)).collect()  # at most one row per block
    if not found:
        return whole.limit(0)
    paths = [f"{path}/rows/_month={r['_month']}/_block={r['_block']}" for r in sorted(found)]
    opened = spark.read.schema(whole.schema).option("basePath", f"{path}/rows").parquet(*paths).select(*whole.columns)
    return search_articles(opened, term, fields)
