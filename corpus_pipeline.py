"""The corpus pipeline: toxicity, line dedup, near duplicates, secrets, packing.

Each stage takes and returns the columns of `documents`, the last one returns
pieces of packed sequences. Between stages the rows are written as Parquet to
the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm.line_dedup import dedup_lines
from pressgrid.llm.names import unused
from pressgrid.llm.ngram_join import ngram_components
from pressgrid.llm.packing import pack_documents
from pressgrid.llm.secrets import redact_secrets
from pressgrid.llm.toxicity import score_toxicity, train
from pressgrid.session import new_dir

ORACLE_SQL = None  # the classifier and the packing can't be said in SQL


def _as_before(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of `before`, with n_chars as the texts are now."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text the classifier rejects go; it learns from the labelled documents in `sf_dir`."""
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the smallest doc_id only; all documents stay."""
    return _as_before(dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links (five words, Jaccard 0.8) connect, the smallest doc_id stays.

    Documents without words and rows without doc_id stay. Rows of one doc_id
    stay or go together, but a row that repeats doc_id and text goes.
    """
    found = ngram_components(docs)
    other, text = unused(docs, "_other", "_text")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct()
    kept = docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")
    again = docs.select("doc_id").groupBy("doc_id").count().filter("doc_id is not null and count > 1").select(F.col("doc_id").alias(other))
    if again.isEmpty():
        return kept
    repeated = kept.join(again, F.col("doc_id") == F.col(other), "left_semi").withColumn(text, F.xxhash64("text"))
    return kept.join(again, F.col("doc_id") == F.col(other), "left_anti").unionByName(
        repeated.dropDuplicates(["doc_id", text]).drop(text))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to their kind in brackets; all documents stay."""
    return _as_before(redact_secrets(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 token ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
