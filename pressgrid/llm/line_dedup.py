"""Repeated lines are dropped, found through a sharded minimal perfect hash.

Distinct line hashes are gathered by shard; each shard becomes a minimal perfect
hash with arrays of fingerprints, of document counts and of the documents that
keep the line. Documents send packed hashes to the shards and probe the arrays,
so no lines are joined and no line text is shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pressgrid.llm.buffers import LOWER, SPACE, field_hashes, mixed, packed, slices, text_bytes
from pressgrid.llm.names import unused
from pressgrid.session import settle

SHARD_LINES = 1 << 20
PROBE_LINES = 1 << 21  # lines of documents that one task looks up in a shard; a shard with more is probed by several
LEVELS, SPARE = 24, 1.6


@dataclass
class Lines:
    """Lines of a batch: where each lies, which text it belongs to, and its key's hashes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # each text's first line (n+1 offsets)
    length: np.ndarray  # code points of the key
    key: np.ndarray
    check: np.ndarray


def lines_of(column: pa.Array) -> tuple[np.ndarray, Lines]:
    """A text has one line more than it has \\n. A key is the line without outer white space, A-Z lower-cased."""
    data, offsets = text_bytes(column)
    breaks = np.flatnonzero(data == 10)
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    start[first[:-1]], start[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    end[first[1:] - 1], end[inner] = offsets[1:], breaks
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    key_start, key_end = start.copy(), start.copy()
    some = a < b
    key_start[some], key_end[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    low = LOWER[data]
    return data, Lines(start, end, first, points[key_end] - points[key_start],
                       field_hashes(low, key_start, key_end), field_hashes(low, key_start, key_end, 1))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level, keys that are alone in their cell keep it."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        rest, total = keys, 0
        while len(rest) and len(self.levels) < LEVELS:
            cell = self._cell(rest, len(self.levels), size := max(64, int(SPARE * len(rest))))
            alone = np.bincount(cell, minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little"))
            counts = np.add.reduceat(alone, np.arange(0, size, 64), dtype=np.int64)
            self.before.append(total + np.concatenate(([0], np.cumsum(counts))))
            self.sizes = [*getattr(self, "sizes", []), size]
            total += int(alone.sum())
            rest = rest[~alone[cell]]
        self.rest, self.total = np.sort(rest), total

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not put in gets any slot, or -1."""
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            cell = self._cell(keys[open_], level, self.sizes[level])
            hit = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            at = cell[hit]
            word = np.zeros(len(bits) + 8, np.uint8)
            word[: len(bits)] = bits
            words = word[: len(word) // 8 * 8].view(np.uint64)[at >> 6]
            below = words & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            slot[open_[hit]] = self.before[level][at >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
            if not len(open_):
                return slot
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            own = self.rest[at] == keys[open_]
            slot[open_[own]] = self.total + at[own]
        return slot


@dataclass
class Shard:
    """Repeated lines of one shard: perfect hash, and per slot fingerprint, documents and keeper."""

    slots: PerfectHash
    check: np.ndarray
    count: np.ndarray
    keeper: np.ndarray
    clash: dict[tuple[int, int], int]  # lines whose 64-bit hashes are equal but not their fingerprints

    @classmethod
    def build(cls, key: np.ndarray, check: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> Shard:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twin = np.zeros(len(key), bool)
        twin[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(key) else False
        clash = {(int(k), int(c)): int(d) for k, c, d in zip(key[twin], check[twin], keeper[twin], strict=True)}
        key, check, count, keeper = key[~twin], check[~twin], count[~twin], keeper[~twin]
        slots = PerfectHash(key)
        at = np.argsort(slots.index(key))
        return cls(slots, check[at], count[at].astype(np.uint32), keeper[at], clash)

    def probe(self, key: np.ndarray, check: np.ndarray, absent: np.ndarray) -> np.ndarray:
        """The keeper of each line, or `absent` where the line is not a repeated one."""
        out = absent.copy()
        if len(self.check):
            slot = self.slots.index(key)
            found = slot >= 0
            found[found] = self.check[slot[found]] == check[found]
            out[found] = self.keeper[slot[found]]
        if self.clash:
            for i, pair in enumerate(zip(key.tolist(), check.tolist(), strict=True)):
                out[i] = self.clash.get(pair, out[i])
        return out


_PACKET = "shard long, salt long, key binary, sure binary, low binary, high binary, count binary"


def _grouped(key, check, low, high, count):
    """One entry per line: smallest and largest document, and how many."""
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    head = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
    at = np.flatnonzero(head)
    return (key[at], check[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at),
            np.add.reduceat(count[order], at))


def _packets(shards: int, least: int, combine: bool, parts: dict[int, int] | None = None):
    """Line hashes by shard; combined, one entry per line of a batch, else one per line and document.

    Entries of a shard in `parts` are dealt to so many salts, by line and document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(parts or ()), np.int64)
        salts = np.array([parts[k] for k in hot.tolist()], np.uint64)
        for batch in (p for b in batches for p in slices(b)):
            known = batch.column("doc_id")
            batch = batch.filter(known.is_valid())
            _, lines = lines_of(batch.column("text"))
            doc = np.repeat(batch.column("doc_id").to_numpy(), np.diff(lines.first))
            use = lines.length >= least
            if not use.any():
                continue
            key, check, doc = lines.key[use], lines.check[use], doc[use]
            order = np.lexsort((doc, check, key))  # a document counts a line once
            key, check, doc = key[order], check[order], doc[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (doc[1:] != doc[:-1])))
            key, check, doc = key[new], check[new], doc[new]
            if combine:
                columns = _grouped(key, check, doc, doc, np.ones(len(doc), np.int64))
            else:
                columns = (key, check, doc, doc[:0], doc[:0])
            home = (mixed(columns[0], 1) % np.uint64(shards)).astype(np.int64)
            salt = np.zeros(len(home), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, home), len(hot) - 1)
                own = hot[at] == home
                salt[own] = (mixed(key[own] ^ mixed(doc[own].astype(np.uint64))) % salts[at[own]]).astype(np.int64)
            order = np.lexsort((salt, home))
            cut = np.concatenate(([0], np.flatnonzero(np.diff(home[order]) | np.diff(salt[order])) + 1, [len(home)]))
            rows = [[packed(c[order[a:b]] if len(c) else c) for a, b in zip(cut[:-1], cut[1:], strict=True)] for c in columns]
            first = order[cut[:-1]]
            yield pa.record_batch([pa.array(home[first]), pa.array(salt[first]), *(pa.array(r, pa.binary()) for r in rows)],
                                  ["shard", "salt", "key", "sure", "low", "high", "count"])
    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _build(table: pa.Table) -> pa.Table:
    key, check, low, high, count = _grouped(
        _column(table, "key", np.uint64), _column(table, "sure", np.uint64), _column(table, "low", np.int64),
        _column(table, "high", np.int64), _column(table, "count", np.int64))
    twice = low != high
    shard = Shard.build(key[twice], check[twice], count[twice], low[twice])
    return pa.table({"shard": table.column("shard").slice(0, 1), "arrays": pa.array([pickle.dumps(shard)], pa.binary()),
                     "entries": pa.array([int(count.sum())])})


def _probe(packets: pa.Table, index: pa.Table) -> pa.Table:
    """(doc_id, hashes of lines the document loses), one row per packet and document."""
    docs, lost = [], []
    for blob in index.column("arrays").to_pylist():
        shard: Shard = pickle.loads(blob)
        for k, c, d in zip(*(packets.column(n).to_pylist() for n in ("key", "sure", "low")), strict=True):
            key, doc = np.frombuffer(k, np.uint64), np.frombuffer(d, np.int64)
            drop = shard.probe(key, np.frombuffer(c, np.uint64), doc) != doc
            if drop.any():
                order = np.argsort(doc[drop], kind="stable")
                own, gone = doc[drop][order], key[drop][order]
                cut = np.flatnonzero(np.diff(own)) + 1
                docs.append(own[np.concatenate(([0], cut))])
                lost += [packed(np.unique(g)) for g in np.split(gone, cut)]
    return pa.table({"doc_id": np.concatenate(docs) if docs else np.zeros(0, np.int64), "lost": pa.array(lost, pa.binary())})


def _rewrite(names: list[str], least: int, found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            data, lines = lines_of(batch.column("text"))
            texts, n_dropped = [], []
            raw = data.tobytes()
            for d, lost in enumerate(batch.column(found).to_pylist()):
                a, b = lines.first[d], lines.first[d + 1]
                if not lost:
                    texts.append(raw[lines.start[a] : lines.end[b - 1]])
                    n_dropped.append(0)
                    continue
                gone = np.unique(np.frombuffer(b"".join(lost), np.uint64))
                drop = np.isin(lines.key[a:b], gone) & (lines.length[a:b] >= least)
                texts.append(b"\n".join(raw[x:y] for x, y in zip(lines.start[a:b][~drop], lines.end[a:b][~drop], strict=True)))
                n_dropped.append(int(drop.sum()))
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            columns["n_lines"] = pa.array(np.diff(lines.first).astype(np.int64))
            columns["n_dropped"] = pa.array(n_dropped, pa.int64())
            yield pa.record_batch([columns[n] for n in names], names)
    return run


def line_index(docs: DataFrame, least: int = 10) -> DataFrame:
    """(shard, arrays, entries, shards): the perfect hashes of lines with `least` code points that at least two documents hold.

    `entries` is how many lines the documents look up in the shard, those of one
    document within a batch counted once.
    """
    rows = F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1)
    shards = max(1, math.ceil((docs.agg(rows.alias("n")).first()["n"] or 0) / SHARD_LINES))
    return settle(
        docs.mapInArrow(_packets(shards, least, True), _PACKET).groupBy("shard").applyInArrow(_build, "shard long, arrays binary, entries long")
    ).withColumn("shards", F.lit(shards))


def probe_packets(docs: DataFrame, index: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Packets of the lines that documents look up, and the index with a row per salt of its shard."""
    shards = index.select("shards").first()
    hot = index.filter(F.col("entries") > PROBE_LINES).select("shard", F.ceil(F.col("entries") / PROBE_LINES).alias("salts"))
    parts = {r["shard"]: r["salts"] for r in hot.collect()}  # at most one for PROBE_LINES lines of the table
    packets = docs.mapInArrow(_packets(shards["shards"] if shards else 1, least, False, parts), _PACKET)
    last = F.greatest(F.ceil(F.col("entries") / PROBE_LINES), F.lit(1)) - 1
    return packets, index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("salt"), "arrays")


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and `n_lines` (before) and `n_dropped`.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least `least` code points that two or more doc_ids hold lose all
    their lines except in the smallest doc_id. A null or empty text is one empty
    line and comes back empty. Rows of one doc_id are one document; rows without
    a doc_id keep their lines and count for no other. Other columns stay;
    columns called n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    doc, found = unused(docs, "_doc", "_lost")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = line_index(narrow, least)
    packets, index = probe_packets(narrow, index, least)
    lost = (
        packets.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt"))
        .applyInArrow(_probe, "doc_id long, lost binary")
        .groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("lost").alias(found))
    )
    names = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([
        *(T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema.fields),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    joined = docs.join(lost, F.col("doc_id") == F.col(doc), "left").drop(doc)
    return joined.mapInArrow(_rewrite(names, least, found), schema)
