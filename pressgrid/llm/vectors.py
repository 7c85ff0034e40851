"""Vectors as packed rows: one format for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def packed_vectors(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key long, dim int, vec binary of doubles, norm double) for rows with a key and a usable vector.

    A vector is usable if it is not null or empty, has no null and no non-finite
    component and is not zero. Other columns are dropped, rows are not.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(value).cast("array<double>").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("value")
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
            start, end = offsets[:-1], offsets[1:]
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            full = np.concatenate(([0], np.cumsum(np.nan_to_num(flat) != 0)))
            good = (column.is_valid().to_numpy(zero_copy_only=False) & batch.column("key").is_valid().to_numpy(zero_copy_only=False)
                    & (bad[end] == bad[start]) & (full[end] > full[start]))
            keep = np.flatnonzero(good)
            yield pa.record_batch([
                batch.column("key").take(pa.array(keep)), pa.array((end - start)[keep].astype(np.int32)),
                pa.array([flat[a:b].tobytes() for a, b in zip(start[keep], end[keep], strict=True)], pa.binary()),
                pa.array([float(np.linalg.norm(flat[a:b])) for a, b in zip(start[keep], end[keep], strict=True)], pa.float64())],
                ["key", "dim", "vec", "norm"])

    return rows.mapInArrow(run, "key long, dim int, vec binary, norm double")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small components do no harm."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
