"""Stored tables: read-or-empty, create, append, partition swap."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pressgrid.functions.validation import is_url, split_accepted
from pressgrid.sources.folders import complete, existing, exists, remove_matching


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one of the declared schema where nothing is stored."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored table; it is created empty when missing."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_articles(rows: DataFrame, path: str, rejects: str | None = None) -> None:
    """Append rows with a proper URL by month; the others go to the reject table with their error."""
    error = F.array_compact(F.array(F.when(~is_url(F.col("url")), F.lit("Invalid URL format"))))
    good, bad = split_accepted(rows.withColumn("errors", error))
    # few files per month, and a month that is too big for one task is split
    good.hint("rebalance", F.col("month")).write.mode("append").partitionBy("month").parquet(path)
    if rejects:
        bad.write.mode("append").parquet(rejects)


_BATCH_NAME = re.compile(r"[A-Za-z0-9_.\-]+")


def _ledger(path: str, batch: str) -> str:
    if not _BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch name has letters, digits and _.- only, not {batch!r}")
    return f"{path}/_ledger/batch={batch}"


def appended(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the batch is in the ledger of the table at `path`."""
    return complete(spark, _ledger(path, batch))


def append_batch(rows: DataFrame, path: str, batch: str, rejects: str | None = None) -> dict[str, int]:
    """Append rows under the name of their batch; a batch that is in the ledger adds nothing again.

    Accepted rows go to month and batch partitions, the others to the reject table with their error. A
    batch counts once its ledger entry is written: `read_batches` shows such batches only, and what a broken attempt has left is
    dropped by the next. Returns how many rows were accepted and rejected.
    """
    spark = rows.sparkSession
    entry = _ledger(path, batch)
    if not appended(spark, path, batch):
        remove_matching(spark, f"{path}/month=*/batch={batch}")
        error = F.array_compact(F.array(F.when(~is_url(F.col("url")), F.lit("Invalid URL format"))))
        good, bad = split_accepted(rows.withColumn("errors", error))
        good.withColumn("batch", F.lit(batch)).hint("rebalance", F.col("month")).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)
        rejected = 0
        if rejects:
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
            rejected = spark.read.parquet(f"{rejects}/batch={batch}").count()
        written = existing(spark, f"{path}/month=*/batch={batch}")
        accepted = spark.read.parquet(*written).count() if written else 0  # from the files' footers
        spark.createDataFrame([(accepted, rejected)], "accepted long, rejected long").coalesce(1).write.mode("overwrite").parquet(entry)
    return spark.read.parquet(entry).first().asDict()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in the ledger of a table that `append_batch` writes; empty where there are none."""
    names = spark.read.parquet(f"{path}/_ledger").select("batch").distinct() if exists(spark, f"{path}/_ledger") else None
    if names is None or not existing(spark, f"{path}/month=*"):
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    known = spark.createDataFrame(names.select(F.col("batch").cast("string").alias("batch")).collect(), "batch string")
    # one name per batch: only their partitions are opened
    return spark.read.schema(whole).parquet(path).join(F.broadcast(known), "batch", "left_semi").select(*schema.names)


def swap_months(rows: DataFrame, path: str) -> None:
    """Replace exactly the months present in `rows`."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
