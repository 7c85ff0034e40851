"""Shards by extendible hashing.

A shard is a prefix of the bits of a row's hash. Only prefixes whose rows are too
large get another bit, so the directory of shards is found from byte counts of
prefixes, not from rows: one narrow aggregation over the table, then sums over
its result. Rows find their shard by an equi-join with the directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.operators.ordering import number_rows
from pressgrid.session import settle

BITS = 60  # of a hash; rows that share them all have one key
MARGIN = 4  # bits counted beyond the depth that even shards would have
MORE = 8  # bits added where that was not enough


def hash_bits(key: Column) -> Column:
    """The first BITS bits of md5 of the key as text; a null key hashes like an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _cell(depth: int) -> Column:
    return F.shiftright("_bits", BITS - depth)


def _directory(cells: DataFrame, limit: int, low: int, high: int, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """From (cell of `high` bits, bytes, rows): (cell, depth) with the shallowest prefix that fits, and cells that have none."""
    prefixes = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = prefixes.groupBy(*within, "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).filter(
        (F.col("bytes") <= limit) | (F.col("rows") == 1))
    known = settle(prefixes.join(fits, [*within, "depth", "prefix"], "left_semi").groupBy(*within, "cell").agg(F.min("depth").alias("depth")))
    return known, settle(cells.join(known, [*within, "cell"], "left_anti").select(*within, "cell"))


def shard_rows(rows: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`rows` with `shard` (the bits of its prefix as text), `depth` (how many) and `row_bytes`.

    A row counts with the bytes of its text (null: none). A shard holds at most
    `limit` bytes, but for a row that is larger by itself and is a shard of its
    own. Rows of one key stay together unless the key alone is over the limit;
    its rows are then numbered and dealt on by the hash of key and number, whose
    bits follow after a dot. Columns of the three names are replaced, others
    stay; an empty table stays empty.
    """
    rows = rows.drop("shard", "depth", "row_bytes")
    names = rows.columns
    rows = rows.toDF(*(f"c{k}" for k in range(len(names))))  # no column of the table's can clash with an inner one
    key, text = (f"c{names.index(c)}" for c in (key, text))
    own = [F.col(c).alias(name) for c, name in zip(rows.columns, names, strict=True)]
    marked = rows.withColumns({
        "_bits": hash_bits(F.col(key)), "row_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")})
    placed, full = _placed(marked, limit)
    result = placed.select(*own, _bits_text().alias("shard"), "depth", "row_bytes")
    if full is None:
        return result
    # keys that fill shards by themselves; only their rows are sorted and kept
    heavy = number_rows(marked.join(full, "_bits", "left_semi"), F.col("_bits"), F.xxhash64(*rows.columns), name="_number")
    above = heavy.withColumn("_above", F.lpad(F.bin("_bits"), BITS, "0")).withColumn(
        "_bits", hash_bits(F.concat_ws(":", F.col("_bits"), F.col("_number"))))
    dealt, _ = _placed(above, limit, "_above")
    return result.unionByName(dealt.select(
        *own, F.concat_ws(".", "_above", _bits_text()).alias("shard"), (F.col("depth") + BITS).alias("depth"), "row_bytes"))


def _bits_text() -> Column:
    return F.expr(f"lpad(bin(shiftright(_bits, {BITS} - depth)), depth, '0')")


def _placed(marked: DataFrame, limit: int, *keys: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the depth of their shard, and the hashes whose rows are too many for any depth (their rows are left out).

    `keys` (if any) has a directory for each of its values.
    """
    within = list(keys)
    sized = marked.groupBy(*within, "_bits").agg(F.sum("row_bytes").alias("bytes"), F.count("*").alias("rows"))
    total = sized.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, MARGIN + max(0, math.ceil(math.log2(max(1, total / limit)))))
    out, open_ = None, None
    while True:
        scope = sized
        if open_ is not None:  # only what is still too large gets more bits
            scope = scope.withColumn("cell", _cell(low - 1)).join(open_, [*within, "cell"], "left_semi")
        cells = scope.groupBy(*within, _cell(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        known, open_ = _directory(cells, limit, low, high, within)
        part = marked.withColumn("_cell", _cell(high)).join(known.withColumnRenamed("cell", "_cell"), [*within, "_cell"]).drop("_cell")
        out = part if out is None else out.unionByName(part)
        if open_.isEmpty():
            return out, None
        if high == BITS:
            return out, open_.toDF("_bits")
        low, high = high + 1, min(BITS, high + MORE)
