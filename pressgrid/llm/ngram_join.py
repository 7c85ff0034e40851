"""Similarity join of documents on word n-grams, as a blocked product of sparse rows.

The documents-by-n-grams incidence matrix is never multiplied as a whole. Two
sets with Jaccard >= t share one of the first n - ceil(t n) + 1 n-grams of each
in any common order. The order taken here puts n-grams of one set only first and
widespread ones last, so a document whose start holds nothing but own n-grams
meets nobody. Documents that do meet form candidate clusters; inside a cluster
blocks of rows are multiplied, overlaps are added up, and pairs under the overlap
their sizes demand are dropped.

How many sets hold an n-gram is counted where the hash is below COUNTED of its
range; the others follow in the order. That fixes one order for all documents.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.buffers import mixed, packed, slices, word_hashes
from pressgrid.llm.components import components
from pressgrid.session import settle

COUNTED = 0.35  # share of the hash range in which holders are counted
HOT_COUNT = 1000  # n-grams in at least so many sets come last
HOT_LIMIT = 100_000  # of those the most frequent; any choice gives the same links
LOCAL_LEAST = 8  # a task reports n-grams it has met so often
BUCKET_TOKENS = 1 << 20
TILE_TOKENS = 1 << 20
ROW_BLOCK, COLUMN_BLOCK, DENSE_FROM = 1024, 4096, 32
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LIMIT = np.uint64(int(COUNTED * 2**64))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text its distinct n-grams as sorted hashes; fewer words than `width` make one n-gram, none an empty set."""
    words, first = word_hashes(column)
    grams = np.zeros(0, np.uint64)
    if len(words) >= width:
        n = len(words) - width + 1
        grams = words[:n].copy()
        for k in range(1, width):
            grams = grams * _STEP + words[k : n + k]
        grams = mixed(grams)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            one = np.uint64(b - a)
            for w in words[a:b]:
                one = np.uint64((int(one) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([one], np.uint64), 1)
        else:
            yield np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return tuple(int(np.sum(mixed(grams ^ _STEP, k), dtype=np.uint64).astype(np.int64)) for k in (0, 1))


def start_length(n: int, percent: int) -> int:
    """How many of its first n-grams a set must be found by."""
    return n - -(-percent * n // 100) + 1


def counted(grams: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams that can be in the start: those that are counted, or as many as the start is long."""
    return grams[: max(int(np.searchsorted(grams, _LIMIT)), start_length(len(grams), percent))]


def _survey(width: int, percent: int):
    """Per document (doc_id, n, s1, s2); per task the counted n-grams it met often (token, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting = [], 0
        for batch in (p for b in batches for p in slices(b)):
            rows = []
            for doc, grams in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width), strict=True):
                rows.append((doc, len(grams), *signature(grams)))
                seen.append(counted(grams, percent) if len(grams) else grams)
                waiting += len(seen[-1])
            ids, n, s1, s2 = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, n, s1, s2)] + [none, none], _SURVEY)
            if waiting >= BUCKET_TOKENS:
                yield _often(seen)
                seen, waiting = [], 0
        if seen:
            yield _often(seen)
    return run


def _often(seen: list[np.ndarray]) -> pa.RecordBatch:
    token, times = np.unique(np.concatenate(seen), return_counts=True)
    often = times >= LOCAL_LEAST
    token, times = token[often].view(np.int64), times[often]
    none = pa.nulls(len(token), pa.int64())
    return pa.record_batch([none] * 4 + [pa.array(token), pa.array(times.astype(np.int64))], _SURVEY)


_SURVEY = ["doc_id", "n", "s1", "s2", "token", "times"]


def _split(hot: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hot) or not len(grams):
        return grams, grams[:0]
    late = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
    return grams[~late], grams[late]


_HOLDERS = "bucket long, tokens binary, sets binary, own binary"


def _holders(width: int, percent: int, hot: np.ndarray, buckets: int):
    """Counted n-grams with their set's signature, packed by bucket.

    `own` rows go along: (signature, rare n-grams sent, start length, widespread
    n-grams of the start).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b, limit=8 << 20)):
            tokens, sets, own = {}, {}, []
            for part in slices(batch):
                for grams in shingle_sets(part.column("text"), width):
                    if not len(grams) or (mark := signature(grams)[0]) in tokens:
                        continue
                    rare, late = _split(hot, counted(grams, percent))
                    length = start_length(len(grams), percent)
                    tokens[mark] = rare
                    sets[mark] = np.full(len(rare), mark, np.int64)
                    own.append((mark, len(rare), length, packed(late[: max(0, length - len(rare))])))
            if not tokens:
                continue
            yield _dealt(np.concatenate(list(tokens.values())), np.concatenate(list(sets.values())), buckets, pickle.dumps(own))
    return run


def _dealt(token: np.ndarray, mark: np.ndarray, buckets: int, own: bytes) -> pa.RecordBatch:
    home = (mixed(token, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.concatenate(([0], np.flatnonzero(np.diff(home[order])) + 1, [len(home)]))
    bounds = list(zip(cut[:-1], cut[1:], strict=True)) if len(home) else [(0, 0)]
    buckets_ = home[order][cut[:-1]] if len(home) else np.zeros(1, np.int64)
    return pa.record_batch([
        pa.array(buckets_), *[pa.array([packed(v[order[a:b]]) for a, b in bounds], pa.binary()) for v in (token, mark)],
        pa.array([own] + [None] * (len(bounds) - 1), pa.binary())], ["bucket", "tokens", "sets", "own"])


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("tokens", np.uint64), ("sets", np.int64)))


_SHARED = "mark long, rare int, length int, late binary, tokens binary, classes binary"


def _shared(table: pa.Table) -> pa.Table:
    """The `own` rows, and for each set its n-grams that other sets hold too, with the size class of their holders."""
    token, mark = _arrays(table)
    order = np.lexsort((mark, token))
    token, mark = token[order], mark[order]
    if len(token):
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])))
        token, mark = token[new], mark[new]
    head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    holders = np.diff(np.concatenate((head, [len(token)])))
    times = np.repeat(holders, holders)
    token, mark, times = token[times > 1], mark[times > 1], times[times > 1]
    order = np.argsort(mark, kind="stable")
    token, mark = token[order], mark[order]
    classes = np.log2(times[order]).astype(np.uint8)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(mark)) + 1, [len(mark)])) if len(mark) else np.zeros(1, np.int64)
    own = [x for blob in table.column("own").to_pylist() if blob for x in pickle.loads(blob)]
    n, m = len(own), len(cut) - 1
    first, rare, length, late = zip(*own, strict=True) if own else ((), (), (), ())
    return pa.table({
        "mark": pa.array([*first, *mark[cut[:-1]].tolist()], pa.int64()),
        "rare": pa.array([*rare, *[None] * m], pa.int32()), "length": pa.array([*length, *[None] * m], pa.int32()),
        "late": pa.array([*late, *[None] * m], pa.binary()),
        "tokens": pa.array([*[None] * n, *[packed(token[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]], pa.binary()),
        "classes": pa.array([*[None] * n, *[packed(classes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]], pa.binary())})


def _starts(buckets: int):
    """What of each set's start other sets may hold; n-grams that repeat within a batch become links and go on once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, marks = [], []
            for mark, rare, length, late, shared, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                token = np.frombuffer(b"".join(shared), np.uint64)
                kind = np.frombuffer(b"".join(classes), np.uint8)
                order = np.lexsort((token, kind, token >= _LIMIT))
                if rare > length:  # the start lies among the counted ones; n-grams of this set only come first
                    order = order[: max(0, length - (rare - len(token)))]
                token = np.concatenate((token[order], np.frombuffer(late, np.uint64)))
                tokens.append(token)
                marks.append(np.full(len(token), mark, np.int64))
            if tokens and sum(map(len, tokens)):
                token, mark, a, b = met(np.concatenate(tokens), np.concatenate(marks))
                yield _dealt(token, mark, buckets, pickle.dumps((a, b)))
    return run


def met(token: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry per n-gram with its smallest set, and a link from each other set to that one."""
    if not len(token):
        return token, mark, mark, mark
    order = np.lexsort((mark, token))
    token, mark = token[order], mark[order]
    head = np.concatenate(([True], token[1:] != token[:-1]))
    low = mark[head][np.cumsum(head) - 1]
    other = mark != low
    pairs = np.unique(np.stack((mark[other], low[other])), axis=1)
    return token[head], mark[head], pairs[0], pairs[1]


def _meet(table: pa.Table) -> pa.Table:
    *_, a, b = met(*_arrays(table))
    links = [pickle.loads(x) for x in table.column("own").to_pylist() if x]
    return pa.table({"a": np.concatenate([a, *(x for x, _ in links)]), "b": np.concatenate([b, *(x for _, x in links)])})


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index its links reach, from the blocked product of the sets' incidence rows."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    token = np.concatenate([sets[i] for i in order])
    _, token, count = np.unique(token, return_inverse=True, return_counts=True)
    dense = (count > DENSE_FROM)[token]
    sparse = ~dense & (count > 1)[token]
    thin = _columns(row[sparse], token[sparse])
    wide_row, (_, wide_token) = row[dense], np.unique(token[dense], return_inverse=True)
    label = np.arange(len(sets))
    for r in range(0, len(sets), ROW_BLOCK):
        r_end = min(r + ROW_BLOCK, len(sets))
        last = np.searchsorted(size, size[r_end - 1] * 100 // percent, "right")  # larger sets can't reach t
        for c in range(r, last, COLUMN_BLOCK):
            c_end = min(c + COLUMN_BLOCK, last)
            overlap = _thin_product(thin, (r, r_end), (c, c_end)) + _wide_product(wide_row, wide_token, (r, r_end), (c, c_end))
            either = size[r:r_end, None] + size[None, c:c_end] - overlap
            i, j = np.nonzero(100 * overlap >= percent * either)
            label = joined(label, i + r, j + c)
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, label, order)
    out = np.empty(len(sets), np.int64)
    out[order] = least[label]
    return out


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after links i-j: each the smallest label that is reached."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def _columns(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by row, and by token: (row, token) by row, rows by token, where each token's rows start."""
    by = np.argsort(token, kind="stable")
    start = np.searchsorted(token[by], np.arange(token.max() + 2 if len(token) else 1))
    return row, token, row[by], start


def _thin_product(entries, rows: tuple[int, int], columns: tuple[int, int]) -> np.ndarray:
    """Overlap counts from n-grams in few rows: every two rows of an n-gram, added up."""
    row, token, by_token, start = entries
    shape = (rows[1] - rows[0], columns[1] - columns[0])
    out = np.zeros(shape[0] * shape[1], np.int64)
    a, b = np.searchsorted(row, rows)
    for k in range(a, b, 1 << 18):
        r, t = row[k : min(b, k + (1 << 18))], token[k : min(b, k + (1 << 18))]
        n = start[t + 1] - start[t]
        at = np.repeat(start[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        i, j = np.repeat(r, n) - rows[0], by_token[at]
        fits = (j >= columns[0]) & (j < columns[1])
        out += np.bincount(i[fits] * shape[1] + j[fits] - columns[0], minlength=len(out))
    return out.reshape(shape)


def _wide_product(row: np.ndarray, token: np.ndarray, rows: tuple[int, int], columns: tuple[int, int]) -> np.ndarray:
    """Overlap counts from n-grams in many rows: dense blocks of the incidence matrix, multiplied."""
    out = np.zeros((rows[1] - rows[0], columns[1] - columns[0]), np.float32)
    if not len(row):
        return out.astype(np.int64)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    for t in range(0, token[-1] + 1, 2048):
        a, b = np.searchsorted(token, (t, t + 2048))
        r, w = row[a:b], token[a:b] - t
        parts = []
        for low, high in (rows, columns):
            part = np.zeros((high - low, 2048), np.float32)
            own = (r >= low) & (r < high)
            part[r[own] - low, w[own]] = 1
            parts.append(part)
        if parts[0].any() and parts[1].any():
            out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _with_sets(width: int):
    """Texts to sets, kept where they are the set that was asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            wanted = zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True)
            sets = list(shingle_sets(batch.column("text"), width))
            keep = [k for k, (s, w) in enumerate(zip(sets, wanted, strict=True)) if signature(s) == w]
            if keep:
                some = batch.select(["doc_id", "comp", "tiles"]).take(pa.array(keep, pa.int64()))
                yield pa.record_batch([*some.columns, pa.array([packed(sets[k]) for k in keep], pa.binary())],
                                      ["doc_id", "comp", "tiles", "grams"])
    return run


def _tile(percent: int):
    def run(table: pa.Table) -> pa.Table:
        comp = table.column("comp").to_numpy()
        doc = table.column("doc_id").to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        a, b = [doc[:0]], [doc[:0]]
        order = np.argsort(comp, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(own) > 1:
                low = linked([sets[k] for k in own], percent)
                a.append(doc[own])
                b.append(doc[own][low])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": a[a != b], "b": b[a != b]})
    return run


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs` (doc_id, text): links where Jaccard >= percent / 100.

    A document's set holds the hashes of its distinct `width`-word n-grams; with
    fewer words, the whole sequence as one; a null or wordless text has an empty
    set and links with nothing. Rows of one doc_id are one node. A null doc_id
    links with nothing and gets a null component. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = settle(docs.mapInArrow(_survey(width, percent), "doc_id long, n long, s1 long, s2 long, token long, times long"))
    sets = survey.filter("n is not null").select("doc_id", "n", "s1", "s2")
    often = (
        survey.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
        .filter(F.col("times") >= HOT_COUNT).orderBy(F.desc("times"), "token").limit(HOT_LIMIT)
    )
    hot = np.sort(np.array([r["token"] for r in often.select("token").collect()], np.int64).view(np.uint64))
    words = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(words * COUNTED / BUCKET_TOKENS))

    same = (
        sets.filter("n > 0 and doc_id is not null").groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    )
    copies = sets.filter("n > 0").join(same.filter("rep <> most"), ["n", "s1", "s2"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    shared = docs.mapInArrow(_holders(width, percent, hot, buckets), _HOLDERS).groupBy("bucket").applyInArrow(_shared, _SHARED)
    starts = (
        shared.groupBy("mark").agg(
            F.max("rare").alias("rare"), F.max("length").alias("length"), F.max("late").alias("late"),
            F.collect_list("tokens").alias("tokens"), F.collect_list("classes").alias("classes"))
        # n-grams of this set only fill the start: it meets nobody
        .filter(F.col("length") > F.col("rare") - F.aggregate("classes", F.lit(0), lambda n, c: n + F.octet_length(c)))
    )
    near = components(starts.mapInArrow(_starts(buckets), _HOLDERS).groupBy("bucket").applyInArrow(_meet, "a long, b long"))
    reps = settle(same.select(F.col("rep").alias("doc_id"), "n", "s1", "s2").join(near.toDF("s1", "comp"), "s1"))
    asked = tiles(reps, percent).withColumnRenamed("doc_id", "_doc")
    rows = asked.join(docs, F.col("_doc") == F.col("doc_id")).select("doc_id", "text", "s1", "s2", "comp", "tiles")
    pairs = (
        rows.mapInArrow(_with_sets(width), "doc_id long, comp long, tiles array<long>, grams binary")
        .select("doc_id", "comp", "grams", F.explode("tiles").alias("tile"))
        .groupBy("tile").applyInArrow(_tile(percent), "a long, b long")
    )
    roots = components(copies.unionByName(pairs)).toDF("doc_id", "root")
    return sets.join(roots, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def tiles(reps: DataFrame, percent: int) -> DataFrame:
    """Which blocks a set is multiplied in: `tiles`, ids of tasks; clusters of one set are left out.

    Small clusters share tasks. A large one is cut by size, in classes as wide as
    t allows, and by hash within a class; blocks of one class and of neighbouring
    classes meet.
    """
    step = math.log(100 / percent) + 1e-3
    reps = reps.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    blocks = (
        reps.groupBy("comp", "cls").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
        .groupBy("comp").agg(
            F.sum("tokens").alias("total"), F.sum("sets").alias("members"),
            F.map_from_entries(F.collect_list(F.struct("cls", F.ceil(F.col("tokens") / TILE_TOKENS).cast("int")))).alias("cut"))
        .filter("members > 1")
    )
    whole = blocks.filter(F.col("total") <= TILE_TOKENS).agg(F.sum("total").alias("t")).first()["t"] or 0
    shared = max(1, math.ceil(whole / TILE_TOKENS))
    own = F.pmod(F.xxhash64("doc_id"), F.col("cut")[F.col("cls")])

    def with_class(other, low, mine):
        """Tile ids of this row's block with every block of class `other`."""
        n = F.coalesce(F.col("cut")[other], F.lit(0))
        js = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(js, lambda j: F.xxhash64("comp", low, *mine(j)))

    cls = F.col("cls")
    large = F.concat(
        with_class(cls, cls, lambda j: (F.lit(0), F.least(own, j), F.greatest(own, j))),
        with_class(cls + 1, cls, lambda j: (F.lit(1), own, j.cast("long"))),
        with_class(cls - 1, cls - 1, lambda j: (F.lit(1), j.cast("long"), own)),
    )
    small = F.array(F.pmod(F.xxhash64("comp"), F.lit(shared)))
    return reps.join(blocks, "comp").select(
        "doc_id", "s1", "s2", "comp", F.when(F.col("total") <= TILE_TOKENS, small).otherwise(large).alias("tiles"))
