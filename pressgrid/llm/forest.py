"""Near-duplicate vectors by a forest of random-projection trees.

In each tree a cell is split by a random direction into two halves that overlap
by SPILL on both sides; cells that are still too large are split again, round by
round, so no task ever holds more than a sample of a cell. Vectors are compared
in blocks within leaves. A pair that meets in several leaves counts in the first
one only, so links are counted without making pairs, and each leaf hands on
links to its smallest members for the union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.components import components
from pressgrid.llm.ngram_join import joined
from pressgrid.llm.vectors import matrix, packed_vectors, unit
from pressgrid.session import settle

TREES, SPILL = 5, 0.025
LEAF = 1024  # a cell with more vectors is split if it can be
SAMPLE = 4096  # rows of a cell that fit its directions' thresholds, at most about so many
LEAST_SAMPLE = 48  # rows under which a node is not split
BLOCK = 2048


def _directions(cell: int, nodes: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(abs(cell) & 0x7FFFFFFFFFFFFFFF)
    d = rng.normal(size=(nodes, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _fit(table: pa.Table) -> pa.Table:
    """Thresholds of a cell's nodes (NaN: leaf), chosen where fewest sampled rows lie within the overlap."""
    cell, dim, total = (table.column(c)[0].as_py() for c in ("cell", "dim", "total"))
    order = np.argsort(table.column("key").to_numpy())
    x = unit(matrix(table.column("vec"), dim))[order]
    depth = max(1, min(math.ceil(math.log2(total / LEAF)), 7))
    nodes = (1 << depth) - 1
    direction, cut = _directions(cell, nodes, dim), np.full(nodes, np.nan)
    inside = {0: np.arange(len(x))}
    for node in range(nodes):
        rows = inside.pop(node, None)
        if rows is None or len(rows) < LEAST_SAMPLE:
            continue
        p = np.sort(x[rows] @ direction[node])
        places = np.quantile(p, np.linspace(0.35, 0.65, 13))
        held = np.searchsorted(p, places + SPILL, "right") - np.searchsorted(p, places - SPILL)
        best = int(np.argmin(held))
        if held[best] > 0.5 * len(rows):  # as tight as the overlap: its members are mostly links
            continue
        cut[node] = places[best]
        q = x[rows] @ direction[node]
        inside[2 * node + 1], inside[2 * node + 2] = rows[q <= places[best] + SPILL], rows[q >= places[best] - SPILL]
    return pa.table({"cell": pa.array([cell]), "cut": pa.array([cut.tobytes()], pa.binary()), "splits": pa.array([bool(~np.isnan(cut[0]))])})


def _children(cell: int, nodes: np.ndarray) -> np.ndarray:
    ids = np.array([hash((cell, int(n))) for n in np.unique(nodes)], np.int64)
    return ids[np.searchsorted(np.unique(nodes), nodes)]


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cell) of the parts that each vector falls into."""
    for batch in batches:
        cells, keys = batch.column("cell").to_numpy(), batch.column("key").to_numpy()
        out_key, out_cell = [], []
        for cell in np.unique(cells):
            own = np.flatnonzero(cells == cell)
            some = batch.take(pa.array(own))
            dim = some.column("dim")[0].as_py()
            cut = np.frombuffer(some.column("cut")[0].as_py(), np.float64)
            x = unit(matrix(some.column("vec"), dim))
            p = x @ _directions(int(cell), len(cut), dim).T
            row, node = np.arange(len(own)), np.zeros(len(own), np.int64)
            while len(row):
                at = np.where(node < len(cut), cut[np.minimum(node, len(cut) - 1)], np.nan)
                done = np.isnan(at)
                out_key.append(keys[own][row[done]])
                out_cell.append(_children(int(cell), node[done]))
                row, node, at = row[~done], node[~done], at[~done]
                q = p[row, node]
                left, right = q <= at + SPILL, q >= at - SPILL
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        if out_key:
            yield pa.record_batch([pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_cell))], ["key", "cell"])


def leaves(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """(key, cell) for the leaves of every tree that a vector (key, dim, vec) falls into."""
    cells = vectors.select("key", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "dim").select(
        "key", F.xxhash64("tree", "dim").alias("cell"))
    done = None
    while True:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("total"))
        large = settle(sizes.filter(F.col("total") > LEAF))
        if large.isEmpty():
            return cells if done is None else done.unionByName(cells)
        rows = cells.join(large, "cell").join(vectors, "key")
        share = F.pmod(F.xxhash64("key", "cell"), F.lit(1 << 20)) < F.lit(SAMPLE << 20) / F.col("total")
        cut = settle(rows.filter(share).groupBy("cell").applyInArrow(_fit, "cell long, cut binary, splits boolean").filter("splits"))
        # cells that are small, or too tight to split, are leaves
        final = cells.join(cut.select("cell"), "cell", "left_anti")
        done = settle(final if done is None else done.unionByName(final))
        if cut.isEmpty():
            return done
        cells = settle(cells.join(cut, "cell").join(vectors, "key").select("key", "dim", "vec", "cell", "cut").mapInArrow(
            _route, "key long, cell long"))


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Links within a block, or between two: per vector how many others, and the smallest member it reaches."""
        cell = table.column("cell")[0].as_py()
        dim = table.column("dim")[0].as_py()
        two = table.column("two")[0].as_py()
        key, name, times = (table.column(c).to_numpy() for c in ("key", "name", "times"))
        side = table.column("block").to_numpy()
        x = unit(matrix(table.column("vec"), dim))
        homes = table.column("cells").to_pylist()
        width = max(map(len, homes))
        home = np.array([h + [h[-1]] * (width - len(h)) for h in homes], np.int64)
        order = np.argsort(name, kind="stable")
        key, name, times, side, x, home = (v[order] for v in (key, name, times, side, x, home))
        links, label = np.zeros(len(key), np.int64), np.arange(len(key))
        for a in range(0, len(key), 512):
            i, j = np.nonzero(x[a : a + 512] @ x.T >= least)
            i += a
            fits = i < j
            if two:
                fits &= side[i] != side[j]
            i, j = i[fits], j[fits]
            for k in range(0, len(i), 1 << 17):
                u, v = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
                own = _first_common(home, u, v) == cell
                np.add.at(links, u[own], times[v[own]])
                np.add.at(links, v[own], times[u[own]])
            label = joined(label, i, j)
        some = (links > 0) | (label != np.arange(len(key)))
        return pa.table({"key": key[some], "links": links[some], "name": name[some], "low": name[label][some]})
    return run


def _first_common(home: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest leaf that both rows lie in; each row's leaves are sorted."""
    found = np.zeros(len(i), np.int64)
    open_ = np.ones(len(i), bool)
    for k in range(home.shape[1]):
        leaf = home[i, k]
        hit = open_ & (home[j] == leaf[:, None]).any(axis=1)
        found[hit] = leaf[hit]
        open_ &= ~hit
    return found


def near_vectors(
    rows: DataFrame, key: str = "vec_id", value: str = "embedding", least: float = 0.95, trees: int = TREES,
) -> DataFrame:
    """(key, n_links, component_id, kept) per row: links between vectors with cosine >= `least`.

    `n_links` counts the other rows linked directly, `component_id` is the
    smallest key that links reach, `kept` marks rows that are that key. Equal
    vectors are compared once and counted as often as they occur. A vector that
    is null, empty or zero or holds null or non-finite components, a row without
    key, and vectors of different lengths link with nothing. Other columns are
    ignored.
    """
    ids = rows.select(F.col(key).cast("long").alias("key"), value)
    hashed = packed_vectors(ids, "key", value).withColumns({
        "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    same = settle(
        hashed.groupBy("h1", "h2").agg(
            F.min("key").alias("name"), F.count("*").alias("times"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
        .withColumn("key", F.monotonically_increasing_id()))
    vectors = same.select("key", "dim", "vec")
    cells = leaves(vectors, trees)
    homes = cells.groupBy("key").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    blocks = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = (
        same.select("key", "name", "times", "dim", "vec").join(homes, "key")
        .withColumn("cell", F.explode("cells")).join(blocks, "cell").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("two", F.col("low") < F.col("high"))
    )
    met = settle(
        placed.select("cell", "low", "high", "two", "block", "key", "name", "times", "dim", "vec", "cells")
        .groupBy("cell", "low", "high").applyInArrow(_compare(least), "key long, links long, name long, low long"))
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("name").alias("a"), F.col("low").alias("b"))).toDF("name", "root")
    groups = same.join(links, "key", "left").join(roots, "name", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "name").alias("component_id"))
    usable = hashed.select("key", "h1", "h2").join(groups, ["h1", "h2"]).select("key", "n_links", "component_id")
    # rows whose vector can't be used
    rest = ids.select("key", F.col(value).cast("array<double>").alias("v")).filter(
        F.col("key").isNull() | F.col("v").isNull() | (F.size("v") == 0)
        | F.exists("v", lambda c: c.isNull() | F.isnan(c) | F.abs(c).isin(float("inf"))) | ~F.exists("v", lambda c: c != 0))
    lone = rest.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return usable.unionByName(lone).select(
        F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
