"""Numbering and ranking without a single-task window.

A window over one partition, or over a group that holds a third of the table,
ends in one task. Here rows are range-partitioned by the full sort order, so
even one huge group is spread over many tasks; a row's number is the size of
the partitions before its own plus its place within its partition. The sorted
rows are checkpointed once so that places and sizes always describe the same
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrid.operators.lookup import lookup
from pressgrid.session import settle

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, place below


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("_at", F.monotonically_increasing_id())
    return (
        settle(tagged)
        .withColumn("_part", F.shiftrightunsigned("_at", _PLACE_BITS))
        .withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_at")
    )


def _before(sizes: DataFrame, *within: str) -> DataFrame:
    """Running total of `_n` over the partitions before each one (one row per partition)."""
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def number_rows(df: DataFrame, *order: Column, name: str = "row_no", start: Column | int = 1) -> DataFrame:
    """Consecutive numbers from `start` in the given (unique) order."""
    placed = _placed(df, list(order))
    # one row per range partition: bounded by the partition count, so it may be broadcast
    offsets = _before(placed.groupBy("_part").agg(F.count("*").alias("_n"))).select("_part", "_before")
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_place") + first).cast("long"))
        .drop("_part", "_place", "_before")
    )


def rank_within(
    df: DataFrame, key: str, *order: Column, rank: str = "rank", size: str = "group_size"
) -> DataFrame:
    """ROW_NUMBER and COUNT(*) per key; a key of any size stays spread over its range partitions."""
    placed = _placed(df, [F.col(key).asc_nulls_first(), *order])
    pieces = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy(key)  # per key at most one row per range partition
    pieces = _before(pieces, key).withColumn(size, F.sum("_n").over(whole))
    pieces = pieces.withColumnsRenamed({key: "_key", "_part": "_piece"}).drop("_n")
    # (key, partition) spreads a hot key as widely as the range partitioning did
    return (
        placed.join(pieces, (F.col("_part") == F.col("_piece")) & F.col(key).eqNullSafe(F.col("_key")))
        .withColumn(rank, F.col("_before") + F.col("_place") - F.col("_first") + 1)
        .drop("_key", "_part", "_piece", "_place", "_first", "_before")
    )


def number_by(df: DataFrame, by: list[str], *order: Column, name: str, start: int = 0) -> DataFrame:
    """As `number_rows`, but only the columns `by`, which the order reads, and a hash of the row are sorted and stored.

    The numbers then go back to the rows by these: to the scan when they are measured few, else by a
    key join. So texts are neither sorted nor written. Rows equal in `by` and in their hash share a
    range of numbers; those few are ranked within it.
    """
    fields = [F.col(c) for c in by]
    keyed = df.withColumn("_same", F.struct(*fields, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")))
    numbers = number_rows(keyed.select("_same", *fields), *order, F.col("_same._row"), name="_at", start=start)
    places = settle(numbers.groupBy("_same").agg(F.min("_at").alias(name), F.count("*").alias("_copies")))
    found = lookup(keyed, places, "_same", "inner", spread=["_same"])
    once = found.filter("_copies = 1").select(*df.columns, name)
    if places.filter("_copies > 1").isEmpty():
        return once
    copies = rank_within(found.filter("_copies > 1"), "_same", rank="_rank", size="_size")
    return once.unionByName(copies.withColumn(name, F.col(name) + F.col("_rank") - 1).select(*df.columns, name))


def assign_ids(new_rows: DataFrame, table: DataFrame, *order: Column, by: list[str], name: str = "id") -> DataFrame:
    """MAX(id)+1, +2, … for new rows in the given order, which reads the columns `by`."""
    top = table.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()
    return number_by(new_rows, by, *order, name="_n", start=1).withColumn(name, F.col("_n") + top).drop("_n")


def fill_missing_ids(table: DataFrame, name: str = "id") -> DataFrame:
    """Rows without an id get the next free ones, in (updated_at, url) order."""
    fresh = assign_ids(
        table.filter(F.col(name).isNull()).drop(name), table,
        F.asc_nulls_first("updated_at"), F.asc_nulls_first("url"), by=["updated_at", "url"], name=name,
    )
    return table.filter(F.col(name).isNotNull()).unionByName(fresh.select(*table.columns))


def stagger_timestamps(df: DataFrame, base: Column, *order: Column, by: list[str], name: str = "updated_at") -> DataFrame:
    """base, base + 1 s, base + 2 s, … in the given order."""
    numbered = number_by(df, by, *order, name="_n")
    return numbered.withColumn(name, base + F.make_interval(secs=F.col("_n"))).drop("_n")


def batches(df: DataFrame, size: int, *order: Column, by: list[str], name: str = "batch_no") -> DataFrame:
    """Number of the fixed-size batch each row falls into (reporting only; work is cut by partitions)."""
    return number_by(df, by, *order, name="_n").withColumn(
        name, F.floor(F.col("_n") / size).cast("long")
    ).drop("_n")


def latest_by(df: DataFrame, key: Column, when: Column, *cols: str, key_name: str = "key") -> DataFrame:
    """The newest row per key; map-side combined, so hot keys shrink before the shuffle."""
    picked = F.max_by(F.struct(*cols), when).alias("_r")
    return df.groupBy(key.alias(key_name)).agg(picked).select(key_name, "_r.*")


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """First row of each key by position (unique). The aggregate sees key and position only; rows are then picked by both."""
    first = df.groupBy(F.col(key).alias("_k")).agg(F.min(pos).alias("_p"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_k")) & F.col(pos).eqNullSafe(F.col("_p")), "left_semi")
