"""Audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def log_context(*cols: str | Column) -> Column:
    """Columns as a JSON text."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def log_row(
    step: str, severity: str, message: str | Column, context: Column, run_id: Column, url: Column, proc: str,
    started: Column, ts: Column,
) -> Column:
    """One audit record."""
    text = message if isinstance(message, Column) else F.lit(message)
    elapsed = ((ts.cast("double") - started.cast("double")) * 1000).cast("long")
    return F.struct(
        run_id.alias("run_id"), F.coalesce(url, F.lit("")).alias("url"), F.lit(proc).alias("proc"),
        F.lit(step).alias("step"), F.lit(severity).alias("severity"), text.alias("message"),
        context.alias("context"), elapsed.alias("ms_elapsed"), ts.alias("ts"))


def write_log(df: DataFrame, rows: list[Column]) -> DataFrame:
    """The audit rows of each input row; NULL entries are left out."""
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("_r")).select("_r.*")


def run_summary(log: DataFrame) -> DataFrame:
    """Rows per step and severity."""
    return log.groupBy("step", "severity").agg(F.count("*").alias("n"))
