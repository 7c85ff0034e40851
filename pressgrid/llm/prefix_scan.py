"""Running sums along sorted keys of any size, composed from the pieces that range partitions hold.

Rows are range-partitioned by key and order, so a key with a third of all rows is
spread over many tasks. A piece of a key is summed up as (how many rows, their
sums); pieces combine by an associative product, so every piece only needs the
product of those before it. There is one such value per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.session import settle

PRIME = (1 << 31) - 1
Piece = tuple[int, int, tuple[int, ...]]  # key, rows, sums


def power(base: int, exponent: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponent modulo a number below 2**31, by repeated squaring."""
    left, square = exponent.astype(np.uint64), np.uint64(base % modulus)
    out = np.full(len(left), 1 % modulus, np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(modulus), out)
        square = square * square % np.uint64(modulus)
        left = left >> np.uint64(1)
    return out


def combine(first: Piece, second: Piece, bases: list[int] | None, modulus: int) -> Piece:
    """The product of two pieces of one key. With bases a sum is of value * base ** place, modulo `modulus`."""
    _, rows, sums = first
    if bases is None:
        return second[0], rows + second[1], tuple(a + b for a, b in zip(sums, second[2], strict=True))
    return second[0], rows + second[1], tuple(
        (a + pow(base, rows, modulus) * b) % modulus for a, b, base in zip(sums, second[2], bases, strict=True))


def _scan(batch: pa.RecordBatch, key: str, values: list[str], bases: list[int] | None, modulus: int, before: Piece | None):
    """Place and running sums of each row of a sorted batch, and the piece at its end."""
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    start = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    place = np.arange(len(keys)) - first + 1
    carried = (keys == before[0]) & (first == 0) if before else np.zeros(len(keys), bool)
    place = place + (before[1] if before else 0) * carried
    sums = []
    for k, name in enumerate(values):
        v = batch.column(name).to_numpy(zero_copy_only=False)
        if bases is not None:
            v = v.astype(np.uint64) * power(bases[k], place, modulus) % np.uint64(modulus)
        total = np.cumsum(v)
        total = total - (total[first] - v[first])
        extra = np.where(carried, before[2][k] if before else 0, 0).astype(total.dtype)
        total = total + extra
        sums.append((total % np.uint64(modulus)).astype(np.int64) if bases is not None else total.astype(np.int64))
    return place, sums, (int(keys[-1]), int(place[-1]), tuple(int(s[-1]) for s in sums))


def running(
    df: DataFrame, key: str, order: list[Column], values: dict[str, str], place: str, bases: list[int] | None = None, modulus: int = PRIME,
) -> DataFrame:
    """`df` with each row's place within its key and running sums of `values` (column -> name of its sum).

    `key` and the values are long without nulls (with bases: values from 0 to
    below `modulus`, summed as value * base ** place modulo `modulus`). Rows equal
    in all of `order` may stand in any order, so they should be equal altogether.
    """
    names, columns = df.columns, list(values)
    sort = [F.col(key), *order]
    placed = settle(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = head = last = None
        for batch in batches:
            if len(batch):
                part = batch.column("__part")[0].as_py()
                head = batch.column(key)[0].as_py() if head is None else head
                last = _scan(batch, key, columns, bases, modulus, last)[2]
        if last is not None:
            yield pa.record_batch([pa.array([v]) for v in (part, head, last[0], last[1])] + [pa.array([list(last[2])], pa.list_(pa.int64()))],
                                  ["part", "head", "key", "rows", "sums"])

    # one row per partition
    found = placed.mapInArrow(ends, "part long, head long, key long, rows long, sums array<long>").collect()
    starts: dict[int, Piece] = {}
    state: Piece | None = None
    for r in sorted(found, key=lambda r: r["part"]):
        tail: Piece = (r["key"], r["rows"], tuple(r["sums"]))
        if state is not None and state[0] == r["head"]:
            starts[r["part"]] = state
            state = combine(state, tail, bases, modulus) if r["head"] == r["key"] else tail
        else:
            state = tail

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                before = last or starts.get(batch.column("__part")[0].as_py())
                at, sums, last = _scan(batch, key, columns, bases, modulus, before)
                yield pa.record_batch([*(batch.column(n) for n in names), pa.array(at), *map(pa.array, sums)], [*names, place, *values.values()])

    schema = placed.select(*names, *(F.lit(0).cast("long").alias(n) for n in (place, *values.values()))).schema
    return placed.mapInArrow(summed, schema)
