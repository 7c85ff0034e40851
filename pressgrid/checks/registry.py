"""Where queries and their SQL counterparts are kept together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrid.checks.views import sql_views, view

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def check(name: str, uses: str = "", sql: str | None = None, text: str = "") -> Callable[[Run], Run]:
    """Register a query. `sql` may name the views in `uses`; `text` columns are compared as text
    (times, dates and numbers that may be NULL, which the engines' clients render differently)."""
    columns = text.split()

    def add(run: Run) -> Run:
        def plain(spark: SparkSession, folder: str) -> DataFrame:
            df = run(spark, folder)
            return df.withColumns({c: F.col(c).cast("string") for c in columns}) if columns else df

        QUERIES[name] = plain
        if sql is not None:
            body = f"{sql_views(*uses.split())}\n{sql.strip()}" if uses else sql.strip()
            if columns:
                casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
                body = f"SELECT * REPLACE ({casts}) FROM (\n{body}\n) AS q"
            ORACLES[name] = body
        return run

    return add


def latest(df: DataFrame, column: str = "updated_at") -> Column:
    """The newest time in a table: the reproducible 'now' of the queries."""
    return df.agg(F.max(column)).scalar()


def load(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [view(spark, folder, n) for n in names]
