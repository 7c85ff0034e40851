"""Key joins that survive a hot key and never broadcast something unmeasured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Bounded probe: reads at most rows+1 rows and adds up their width."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(8)) for c in df.columns), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= rows and (seen["b"] or 0) <= size


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left",
    hot_rows: int | None = None, spread: list[str] | None = None,
) -> DataFrame:
    """Join on one key; a key with more than `hot_rows` left rows is split into pieces of about that size.

    Only hot keys are repeated on the right, once per piece. There can be at
    most rows/hot_rows hot keys, which bounds the broadcast. Rows of a hot key,
    and rows without a key, are spread by the hash of their other columns
    (`spread`), which is the same on every retry.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    other = spread or [c for c in left.columns if c != key] or [key]
    counted = left.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > hot_rows)
    hot = F.broadcast(counted.select(
        F.col(key).alias("_hot"), F.ceil(F.col("count") / hot_rows).cast("long").alias("_pieces")))
    piece = F.xxhash64(*other)
    salted_left = (
        left.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col(key).isNull(), piece).when(F.col("_hot").isNotNull(), F.pmod(piece, "_pieces"))
                    .otherwise(F.lit(0)))
        .drop("_hot", "_pieces")
    )
    pieces = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("_pieces") - 1))
    salted_right = (
        right.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.coalesce(pieces, F.array(F.lit(0).cast("long")))))
        .drop("_hot", "_pieces")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", **salting) -> DataFrame:
    """Join to a table with one row per key: broadcast when measured small, else salted."""
    if is_small(right):
        return left.join(F.broadcast(right), key, how)
    return salted_join(left, right, key, how, **salting)
