"""The prefix trie of rebuilt conversations, from fingerprints that are put together without their texts.

A turn is known by the SHA-256 of its role and text. A sequence of turns has a
polynomial fingerprint in several lanes; fingerprints form a monoid, so that of a
rebuilt prefix follows from those of the base's head and of the own turns:
head + base ** (k - h) * (own prefix - skipped prefix). Rows that share a fingerprint form a
node, and a node counts only when the turns its rows refer to, and their parents, are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.llm.prefix_scan import PRIME, power, running
from pressgrid.operators.lookup import lookup, salted_join
from pressgrid.session import settle

FAMILY, HEADS = 20, 4  # conversations of one base, and h is below HEADS
LANES = 4
CHUNK_IDS = 512
WORDS = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "f1", "f2"]


def head_size() -> Column:
    """How many turns of its base a conversation takes over."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS


def bases_of(attempt: int, modulus: int) -> list[int]:
    rng = np.random.default_rng(1000 + attempt)
    return [int(b) for b in rng.integers(2, modulus - 1, LANES)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words): one narrow row per turn; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat_ws(":", F.length(role), F.concat(role, text)), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))


def _digest_parts(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _with_lanes(rows: DataFrame, modulus: int) -> DataFrame:
    """x0.. : the digest as one number below `modulus` per lane; q0.. : the whole digest as longs."""
    names = rows.columns
    lanes, parts = [f"x{k}" for k in range(LANES)], [f"q{k}" for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = batch.column("digest")
            x = _digest_parts(digest, ">u4")[:, :LANES].astype(np.int64) % (modulus - 1) + 1
            q = _digest_parts(digest, ">i8").astype(np.int64)
            yield pa.record_batch([*batch.columns, *(pa.array(x[:, k]) for k in range(LANES)), *(pa.array(q[:, k]) for k in range(4))], [*names, *lanes, *parts])

    return rows.mapInArrow(run, rows.withColumns({n: F.lit(0).cast("long") for n in lanes + parts}).schema).drop("digest")


def _rebuilt_rows(turns: DataFrame, bases: list[int], modulus: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (one row per depth from 1, one row per conversation)."""
    x, own, head = ([f"{c}{k}" for k in range(LANES)] for c in "xog")
    order = [F.asc_nulls_first("turn"), *(F.col(f"q{k}") for k in range(4))]
    placed = settle(running(_with_lanes(turns, modulus), "conv_id", order, {c: f"s{k}" for k, c in enumerate(x)}, "place", bases, modulus).drop("turn"))
    sums = [f"s{k}" for k in range(LANES)]

    def at(place: Column, column: str) -> Column:
        return F.max(F.when(F.col("place") == place, F.col(column)))

    # three heads per conversation at most; counted and picked with map-side combine
    convs = placed.groupBy("conv_id").agg(
        F.max("place").alias("n"), *(at(F.lit(p), s).alias(f"{s}_{p}") for p in range(1, HEADS) for s in sums))

    def picked(count: Column, s: str) -> Column:
        return F.coalesce(*(F.when(count == p, F.col(f"{s}_{p}")) for p in range(1, HEADS)), F.lit(0).cast("long"))

    h = head_size()
    bases_rows = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"{s}_{p}").alias(f"b{s}_{p}") for p in range(1, HEADS) for s in sums))
    plan = (
        convs.withColumns({"h": h.cast("long"), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
        .join(bases_rows, "base", "left")
        .withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
        .select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
                *(picked(F.least("h", "n"), s).alias(o) for s, o in zip(sums, own, strict=True)),
                *(picked(F.col("k"), f"b{s}").alias(g) for s, g in zip(sums, head, strict=True)))
    )
    plan = settle(plan)
    kept = ["words", *x, *sums, *(f"q{k}" for k in range(4))]
    nothing = [F.lit(0).cast("long").alias(c) for c in own + head]
    # a base's first turns meet the conversations of one family only
    heads = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "base").join(
        plan.select("conv_id", "base", "k", "length"), "base").filter("place <= k").select(
        "conv_id", F.col("place").alias("depth"), "length", F.lit(0).cast("long").alias("back"), *kept, *nothing)
    rest = lookup(placed.filter(F.col("place") > h), plan.drop("base"), "conv_id", "inner").select(
        "conv_id", (F.col("k") + F.col("place") - F.col("h")).alias("depth"), "length", (F.col("h") - F.col("k")).alias("back"), *kept, *own, *head)
    shift = np.array([[pow(pow(b, -1, modulus), e, modulus) for e in range(HEADS)] for b in bases], np.uint64)
    m = np.uint64(modulus)

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def c(name: str) -> np.ndarray:
                return batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint64)
            depth, back = c("depth"), c("back").astype(np.int64)
            whole, parent = [], []
            for k, base in enumerate(bases):
                f = (c(f"g{k}") + shift[k][back] * ((c(f"s{k}") + m - c(f"o{k}")) % m)) % m
                whole.append(f)
                parent.append((f + m - c(f"x{k}") * power(base, depth, modulus) % m) % m)
            packed = [(v[a] | (v[a + 1] << np.uint64(31))).astype(np.int64) for v in (whole, parent) for a in (0, 2)]
            yield pa.record_batch(
                [batch.column("conv_id"), batch.column("depth"), pa.array(depth.astype(np.int64) == batch.column("length").to_numpy()), *map(pa.array, packed),
                 batch.column("words"), *(batch.column(f"q{k}") for k in range(4))],
                ["conv_id", "depth", "last", "f1", "f2", "p1", "p2", "words", "q0", "q1", "q2", "q3"])

    rows = heads.unionByName(rest).mapInArrow(
        fingerprints, "conv_id long, depth long, last boolean, f1 long, f2 long, p1 long, p2 long, words long, q0 long, q1 long, q2 long, q3 long")
    return settle(rows), plan.select("conv_id", "length")


def _grouped(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per fingerprint and depth; `same` tells whether its rows' last turns and parents agree."""
    same = [F.min(c) == F.max(c) for c in ("p1", "p2", "q0", "q1", "q2", "q3")]
    agreed = same[0]
    for s in same[1:]:
        agreed = agreed & s
    nodes = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        agreed.alias("same"))
    zero = F.lit(0).cast("long")
    root = plan.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        *(zero.alias(c) for c in _KEY), "n_convs", "conv_id", zero.alias("words"), zero.alias("p1"), zero.alias("p2"), F.lit(True).alias("same"))
    return settle(nodes.unionByName(root))


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per node the SHA-256 over the ids of the conversations that end there.

    Ids are sorted by range, so the ids of one node are spread over tasks and
    leave them as chunks of CHUNK_IDS; only chunks of a node meet, as a stream,
    because a hash is taken in order.
    """
    zero = F.lit(0).cast("long")
    ends = rows.filter("last").select(*_KEY, "conv_id").unionByName(plan.filter("length = 0").select(*(zero.alias(c) for c in _KEY), "conv_id"))
    order = [*_KEY, "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY], axis=1)
                ids = batch.column("conv_id").to_pylist()
                fresh = np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))
                first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                start = np.flatnonzero((np.arange(len(ids)) - first) % CHUNK_IDS == 0)
                stop = [*start[1:], len(ids)]
                yield pa.record_batch([*(pa.array(key[start, k]) for k in range(3)), pa.array([ids[a] for a in start], pa.int64()),
                                       pa.array([",".join(map(str, ids[a:b])) for a, b in zip(start, stop, strict=True)])], [*_KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(found):
            return pa.record_batch([*(pa.array([f[0][k] for f in found], pa.int64()) for k in range(3)), pa.array([f[1] for f in found], pa.string())], [*_KEY, "ends"])

        for batch in batches:
            found = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if key != now:
                    if state:
                        found.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out(found)
        if state:
            yield out([(now, state.hexdigest())])

    kind = "depth long, f1 long, f2 long, "
    cut = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, kind + "first long, ids string")
    return cut.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, kind + "ends string")


def prefix_nodes(conversations: DataFrame, moduli: tuple[int, ...] = (PRIME, PRIME, PRIME)) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Every conv_id is rebuilt from the first turns of its base (conv_id - conv_id % 20) and its own
    turns after as many. Turns go by `turn`, null first; rows of one turn go by the SHA-256 of role
    and text, so repeated rows stand next to each other. Null roles and texts are empty, rows without conv_id are left
    out, and other columns are not read. A table without conversations has no nodes. If a fingerprint
    is found to stand for two sequences, all fingerprints are taken anew with other bases.
    """
    turns = turns_of(conversations)
    for attempt, modulus in enumerate(moduli):
        rows, plan = _rebuilt_rows(turns, bases_of(attempt, modulus), modulus)
        nodes = _grouped(rows, plan)
        if nodes.filter("not same").isEmpty():
            break
    else:
        raise RuntimeError("fingerprints of different sequences collide with all bases")

    up = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(up, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).select(
        *_KEY, "p1", "p2", "conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # A conversation stands for the nodes of its own path from some depth on: a chain. Sums run from a chain's end upwards.
    chained = settle(running(valued, "conv_id", [F.desc("depth")], {"leaf": "leaves", "saved": "tokens"}, "place"))
    chains = settle(chained.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p1", "p2", "leaves", "tokens"), "place").alias("t")).select(
        "conv_id", F.col("t.depth").alias("top"), "t.p1", "t.p2", F.col("t.leaves").alias("leaves"), F.col("t.tokens").alias("tokens")))
    # Above its top a chain adds its whole sum to every node on the same conversation's path.
    below = chains.filter("top > 0").select("conv_id", "top", F.col("leaves").alias("more_leaves"), F.col("tokens").alias("more_tokens"))
    passed = lookup(rows.select("conv_id", *_KEY), below, "conv_id", "inner").filter("depth < top")
    at_root = below.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _KEY), "top", "more_leaves", "more_tokens")
    more = passed.unionByName(at_root).groupBy(*_KEY).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_tokens").alias("more_tokens"))
    # The parent of a chain's top lies in another chain; all other parents lie in the same one.
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(_KEY)))
    tops = chains.filter("top > 0").select("conv_id", F.col("top").alias("depth"), F.struct((F.col("top") - 1).alias("k0"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("key"))
    parents = salted_join(tops, nodes.select(key.alias("key"), F.col("conv_id").alias("above")), "key", "inner").select("conv_id", "depth", "above")
    empty = hashlib.sha256().hexdigest()
    return (
        chained.join(more, _KEY, "left").join(parents, ["conv_id", "depth"], "left").join(_ends(rows, plan), _KEY, "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))
    )
