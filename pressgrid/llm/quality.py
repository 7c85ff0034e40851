"""A quality classifier: a generalised additive model with pairwise interactions over counts of a whole text.

Every feature is cut into bins. Boosting goes round the features in a cycle; each step fits a tree of
three leaves on one feature's bins and adds it to that feature's lookup table. Then the pairs that
explain most of what is left get tables of their own, grown by trees of four leaves on two features.
A text's score is the sum of the table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.buffers import LOWER, SPACE, hashes, runs, slices, text_bytes

THRESHOLD = 0.5
SAMPLE_ROWS = 8000  # labelled rows of each class that are fitted at most, the first by hash of doc_id
BINS, PAIR_BINS, PAIRS = 32, 8, 10
CYCLES, PAIR_CYCLES, PATIENCE = 120, 60, 8
RATE, SHRINK = 0.25, 4.0
BLOCK = 32  # words of a stretch whose share counts by itself
FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "marks", "symbols", "bars", "spaces", "beyond_ascii",
    "same_char", "entropy", "distinct_words", "top_word", "same_word", "marked_words", "upper_words", "worst_upper", "worst_marked",
    "worst_same", "worst_distinct", "log_lines", "line_length", "distinct_lines", "log_longest_word",
)
_UPPER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SYMBOL &= ~_MARK


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Totals of `flags` between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _groups(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner (0 to n-1): how many different values, and how often the most frequent one occurs."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))))
    size = np.diff(np.concatenate((start, [len(o)])))
    top = np.zeros(n)
    np.maximum.at(top, o[start], size)
    return np.bincount(o[start], minlength=n).astype(np.float64), top


def _worst(text: np.ndarray, block: np.ndarray, flag: np.ndarray, n: int) -> np.ndarray:
    """Per text the largest share of flagged words in one block of words."""
    worst = np.zeros(n)
    if len(block):
        size = np.bincount(block)
        share = np.bincount(block, flag) / np.maximum(size, BLOCK // 2)
        first = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
        np.maximum.at(worst, text[first], share[block[first]])
    return worst


def measure(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts have zeros."""
    data, at = text_bytes(column)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    low = LOWER[data]
    size = np.diff(at).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(at))
    chars = _sums((data & 0xC0) != 0x80, at)
    after = np.concatenate((data[1:], [0]))
    upper = _UPPER[data] | ((data == 0xC3) & (after >= 0x80) & (after <= 0x9E))  # A-Z and the capitals from À to Þ
    space, mark, symbol = SPACE[data], _MARK[data], _SYMBOL[data]
    same = np.concatenate(([False], (data[1:] == data[:-1]) & (text[1:] == text[:-1])))
    histogram = np.bincount(text * 256 + low, minlength=n * 256).reshape(n, 256)
    part = _share(histogram, size[:, None])
    entropy = -(part * np.log2(np.where(part > 0, part, 1))).sum(axis=1)

    start, end, first = runs(~space, at)
    words = np.diff(first).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(np.float64)
    word = hashes(low, start, end)
    repeats = np.concatenate(([False], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))) if len(word) else np.zeros(0, bool)
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(upper, out=capitals[1:])
    shouted = capitals[end] - capitals[start] >= np.maximum(2, 0.4 * length)
    last = np.maximum(end - 1, 0)
    marked = symbol[last] | ((data[last] == 33) | (data[last] == 63)) if len(word) else np.zeros(0, bool)
    within = np.arange(len(word)) - first[:-1][owner]
    block = np.concatenate(([0], np.cumsum((np.diff(owner) != 0) | (within[1:] % BLOCK == 0)))) if len(word) else np.zeros(0, np.int64)
    distinct, top = _groups(owner, word, n)
    blocks = int(block[-1]) + 1 if len(block) else 0
    own_block, _ = _groups(block, word, blocks)
    fresh = np.zeros(n)
    if blocks:
        in_block = np.bincount(block)
        np.maximum.at(fresh, owner[np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))], (in_block - own_block) / np.maximum(in_block, BLOCK // 2))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)

    line_start, line_end, line_first = runs(data != 10, at)
    lines = np.diff(line_first).astype(np.float64)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    distinct_lines, _ = _groups(line_owner, hashes(low, line_start, line_end), n)

    columns = (
        np.log1p(chars), np.log1p(words), _share(_sums(~space, at), words), _share(np.bincount(owner, length > 15, n), words),
        _share(_sums(upper, at), chars), _share(_sums(_DIGIT[data], at), chars), _share(_sums(mark, at), chars),
        _share(_sums(symbol, at), chars), _share(_sums(data == 124, at), words), _share(_sums(space, at), chars),
        _share(_sums(data >= 0xC0, at), chars), _share(_sums(same, at), chars), entropy, _share(distinct, words), _share(top, words),
        _share(np.bincount(owner, repeats, n), words), _share(np.bincount(owner, marked, n), words), _share(np.bincount(owner, shouted, n), words),
        _worst(owner, block, shouted, n), _worst(owner, block, marked, n), _worst(owner, block, repeats, n), fresh,
        np.log1p(lines), np.log1p(_share(chars, lines)), _share(distinct_lines, lines), np.log1p(longest),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    return out


@dataclass
class Additive:
    """Bin edges and lookup tables; `base` is the log odds of a text whose entries are all zero."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # per feature: bin -> bin of the pair tables
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            z += table[bins[:, k]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """How much the best cut of ordered bins gains, and the first bin behind it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree_of_three(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with at most three leaves, fitted to gradients `g` and curvatures `h`."""
    pieces = [(0, len(g))]
    for _ in range(2):
        found = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in pieces]
        gain, cut, a, b = max(found, key=lambda f: f[0])
        if gain <= 0:
            break
        pieces.remove((a, b))
        pieces += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in pieces:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def tree_of_four(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best tree that cuts a grid once along each axis."""
    total_g, total_h = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def corners(t):
        a, right, below, all_of = t[:-1, :-1], t[:-1, -1:], t[-1:, :-1], t[-1, -1]
        return a, right - a, below - a, all_of - right - below + a

    quarters = list(zip(corners(total_g), corners(total_h), strict=True))
    gain = sum(_gain(a, b) for a, b in quarters) - _gain(total_g[-1, -1], total_h[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [a[i, j] / (b[i, j] + SHRINK) for a, b in quarters]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Additive:
    """The model of rows `x` with labels `y`; every fifth row only decides when boosting stops."""
    total = weight.sum()
    rate = (float((weight * y).sum()) + 1) / (float(total) + 2)
    model = Additive(float(np.log(rate / (1 - rate))), [], [], [], [], [])
    if not len(y) or y.min() == y.max():
        return model
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], steps)) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    learn = np.arange(len(y)) % 5 != 4 if len(y) >= 100 else np.ones(len(y), bool)
    judge = ~learn if not learn.all() else learn
    z = np.full(len(y), model.base)

    def state():
        p = 1 / (1 + np.exp(-z))
        return np.where(learn, weight * (y - p), 0), np.where(learn, weight * p * (1 - p), 0)

    def loss():
        return float((weight * (np.logaddexp(0, z) - y * z))[judge].sum() / weight[judge].sum())

    def boost(tables, index, grow, cycles):
        """Goes round the tables until the judging rows get no better; keeps the best state."""
        nonlocal z
        best, kept, since = loss(), ([t.copy() for t in tables], z.copy()), 0
        for _ in range(cycles):
            for k, table in enumerate(tables):
                g, h = state()
                add = RATE * grow(*(np.bincount(index[k], v, table.size).reshape(table.shape) for v in (g, h)))
                table += add
                z += add.ravel()[index[k]]
            now = loss()
            since = 0 if now < best - 1e-5 else since + 1
            if now < best:
                best, kept = now, ([t.copy() for t in tables], z.copy())
            if since >= PATIENCE:
                break
        z = kept[1]
        return kept[0]

    model.tables = boost(model.tables, [bins[:, k] for k in range(bins.shape[1])], tree_of_three, CYCLES)
    g, h = state()
    coarse = [c[bins[:, k]] for k, c in enumerate(model.coarse)]
    shape = (PAIR_BINS, PAIR_BINS)

    def gain_of(pair):
        cell = coarse[pair[0]] * PAIR_BINS + coarse[pair[1]]
        return tree_of_four(*(np.bincount(cell, v, PAIR_BINS**2).reshape(shape) for v in (g, h)))[0]

    usable = [k for k, e in enumerate(model.edges) if len(e)]
    model.pairs = sorted(combinations(usable, 2), key=lambda p: (-gain_of(p), p))[:PAIRS]
    cells = [coarse[i] * PAIR_BINS + coarse[j] for i, j in model.pairs]
    model.grids = boost([np.zeros(shape) for _ in model.pairs], cells, lambda a, b: tree_of_four(a, b)[1], PAIR_CYCLES)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on at most `sample_rows` rows of each class (doc_id, quality), the first by hash, measured over their whole texts.

    Rows stand for as many labelled rows as their class has, so the sample does
    not shift the odds. Rows without a label or an id are not used, a null text
    counts as empty. With no labels, or one class only, all scores are the
    smoothed share of label 1.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    count = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows at most
    picked = None
    for value in (0, 1):
        some = known.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * sample_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            x = measure(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.mapInArrow(measured, f"doc_id {kind}, quality int, x array<double>").toPandas()
    got["key"] = [tuple(v) for v in got["x"]]
    got = got.sort_values(["doc_id", "key"], kind="stable")
    y = got["quality"].to_numpy().astype(np.float64)
    x = np.array(got["key"].tolist(), np.float64).reshape(len(y), len(FEATURES))
    weight = np.ones(len(y))
    for value, n in count.items():
        if (y == value).any():
            weight[y == value] = n / (y == value).sum()
    order = np.random.default_rng(5).permutation(len(y))
    scale = len(y) / weight.sum() if len(y) else 1.0
    return fit(x[order], y[order], weight[order] * scale)


def score_quality(docs: DataFrame, model: Additive) -> DataFrame:
    """`docs` with `quality_score` (0 to 1, from the whole text) and `accepted` (score >= THRESHOLD).

    Null and empty texts are scored as texts without words, repeated rows alike.
    Other columns stay; columns of the two names are replaced.
    """
    docs = docs.drop("quality_score", "accepted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            score = model.scores(measure(batch.column("text")))
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array(score >= THRESHOLD)], [*names, "quality_score", "accepted"])

    return docs.mapInArrow(run, docs.withColumns({"quality_score": F.lit(0.0), "accepted": F.lit(True)}).schema)
