"""Nearest neighbours along shifted space-filling curves.

Vectors are projected by a random rotation onto a few axes and ordered along a
Hilbert curve, several times with other rotations and shifts. Each ordering is
range-partitioned by its key; a query is compared with the rows of a window
around its place, and the windows of all curves are merged. The window's width
is measured on a sample of queries against all rows, so that it follows the data.
Vectors of each length have curves, a window and blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pressgrid.llm.vectors import matrix, packed_vectors
from pressgrid.operators.ordering import number_rows
from pressgrid.session import settle

CURVES, AXES, BITS = 8, 6, 7
SAMPLE_ROWS = 4096  # rows from which the axes' quantiles are taken
SAMPLE_QUERIES = 256  # queries on which the window is measured
RECALL = 0.96  # share of their neighbours that must lie in a window
BLOCK = (1024, 8192)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n, axes), each coordinate of `bits` bits."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(axes):
            upper = (x[k] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


class Curves:
    """Rotations, shifts and quantiles; they turn vectors into places on each curve.

    For the largest inner product all rows are brought to one length by one more
    component, which queries have as zero.
    """

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        axes = min(AXES, dim + 1)
        self.longest = longest
        self.rotation = [np.linalg.qr(rng.normal(size=(dim + 1, axes)))[0] for _ in range(CURVES)]
        self.shift = rng.random((CURVES, axes))
        placed = self._placed(sample, False)
        self.quantiles = [np.quantile(placed @ r, np.linspace(0, 1, 257), axis=0) for r in self.rotation]

    def _placed(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.hstack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))))
        x = x / self.longest
        return np.hstack((x, np.sqrt(np.maximum(0, 1 - np.sum(x * x, axis=1, keepdims=True)))))

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        placed, steps = self._placed(x, query), np.linspace(0, 1, 257)
        out = []
        for rotation, shift, quantiles in zip(self.rotation, self.shift, self.quantiles, strict=True):
            y = placed @ rotation
            even = np.stack([np.interp(y[:, k], quantiles[:, k], steps) for k in range(y.shape[1])], axis=1)
            cells = np.minimum((even + shift) / 2 * (1 << BITS), (1 << BITS) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), BITS))
        return out


def _nearest(query: np.ndarray, query_id: np.ndarray, row: np.ndarray, row_id: np.ndarray, k: int) -> pa.RecordBatch:
    """The k rows with the largest inner product for each query, itself left out; ties to the smaller id."""
    ids, near, score = [], [], []
    for a in range(0, len(query), 256):
        s = query[a : a + 256] @ row.T
        s[query_id[a : a + 256, None] == row_id[None]] = -np.inf
        kth = np.partition(s, -k, axis=1)[:, -k] if len(row) > k else np.full(len(s), -np.inf)
        slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(kth), kth, 0)))
        for i in range(len(s)):
            own = np.flatnonzero((s[i] >= kth[i] - slack[i]) & (s[i] > -np.inf))
            exact = np.sum(query[a + i] * row[own], axis=1)  # equal vectors, equal sums
            first = np.lexsort((row_id[own], -exact))[:k]
            ids.append(np.full(len(first), query_id[a + i]))
            near.append(row_id[own][first])
            score.append(exact[first])
    if not ids:
        ids, near, score = [query_id[:0]], [query_id[:0]], [np.zeros(0)]
    return pa.record_batch([pa.array(np.concatenate(v)) for v in (ids, near, score)], ["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score double"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_vectors(
    rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", value: str = "embedding", recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the `k` largest inner products.

    Ties go to the smaller key; a query has fewer rows where there are fewer
    candidates. Rows with a null key or a vector that is null, empty or zero or
    holds null or non-finite components take no part; only vectors of
    one length are compared. Rows of one key are one vector, the smallest. Other
    columns are ignored; an empty table has an empty result.
    """
    vectors = settle(
        packed_vectors(rows, key, value).groupBy("key").agg(F.min(F.struct("dim", "vec", "norm")).alias("v")).select("key", "v.*"))
    dims = sorted(r["dim"] for r in vectors.filter(F.col("key") % every == 0).select("dim").distinct().collect())
    if not dims:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [_of_length(vectors.filter(F.col("dim") == dim), dim, every, k, recall) for dim in dims])


def _of_length(vectors: DataFrame, dim: int, every: int, k: int, recall: float) -> DataFrame:
    """`nearest_vectors` of (key, dim, vec, norm), all of length `dim`."""
    queries = vectors.filter(F.col("key") % every == 0)
    sample = vectors.orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select("vec").toArrow()
    curves = Curves(matrix(sample.column("vec"), dim), vectors.agg(F.max("norm").alias("m")).first()["m"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("key").to_numpy(), matrix(batch.column("vec"), dim)
            asks = ids % every == 0
            for query, own, rows_ in ((False, ids, x), (True, ids[asks], x[asks])):
                for c, place in enumerate(curves.keys(rows_, query)) if len(own) else ():
                    yield pa.record_batch([pa.array(np.full(len(own), c, np.int32)), pa.array(place), pa.array(own), pa.array(np.full(len(own), query))],
                                          ["curve", "place", "key", "asks"])

    ordered = number_rows(
        vectors.mapInArrow(placed, "curve int, place long, key long, asks boolean"),
        F.col("curve"), F.col("place"), F.col("key"), F.col("asks"), name="at", start=0)
    window = _window(vectors, queries, ordered, dim, k, recall)
    size = max(BLOCK[0], min(BLOCK[1], window))
    low = F.floor(F.greatest(F.col("at") - window, F.lit(0)) / size)
    blocks = F.when(F.col("asks"), F.sequence(low, F.floor((F.col("at") + window) / size))).otherwise(F.array(F.floor(F.col("at") / size)))

    def search(table: pa.Table) -> pa.Table:
        x, ids, asks = matrix(table.column("vec"), dim), table.column("key").to_numpy(), table.column("asks").to_numpy()
        ask = np.flatnonzero(asks)[np.unique(ids[asks], return_index=True)[1]]
        row = np.flatnonzero(~asks)[np.unique(ids[~asks], return_index=True)[1]]
        return pa.Table.from_batches([_nearest(x[ask], ids[ask], x[row], ids[row], k)])

    found = (
        ordered.select("key", "asks", F.explode(blocks).alias("block")).distinct().join(vectors.select("key", "vec"), "key")
        .groupBy("block").applyInArrow(search, _FOUND)
    )
    return _first(found, k).select("query_id", "rank", "vec_id", "score")


def _window(vectors: DataFrame, queries: DataFrame, ordered: DataFrame, dim: int, k: int, recall: float) -> int:
    """How far along the curves neighbours lie: on a sample of queries, found exactly against all rows."""
    some = queries.orderBy(F.xxhash64(F.lit(3), "key")).limit(SAMPLE_QUERIES).select("key", "vec").toArrow()
    ask_id, ask = some.column("key").to_numpy(), matrix(some.column("vec"), dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _nearest(ask, ask_id, matrix(batch.column("vec"), dim), batch.column("key").to_numpy(), k)

    true = F.broadcast(settle(_first(vectors.select("key", "vec").mapInArrow(exact, _FOUND), k)).select("query_id", "vec_id"))
    of_query = ordered.filter("asks").select("curve", F.col("key").alias("query_id"), F.col("at").alias("from")).join(true, "query_id")
    of_row = ordered.filter("not asks").select("curve", F.col("key").alias("vec_id"), F.col("at").alias("to")).join(
        F.broadcast(settle(true.select("vec_id").distinct())), "vec_id")
    far = of_query.join(of_row, ["curve", "vec_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("from") - F.col("to"))).alias("far"))
    found = far.agg(F.percentile("far", recall).alias("w")).first()["w"]
    return int(found or 0) + 1
