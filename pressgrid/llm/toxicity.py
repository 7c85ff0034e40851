"""A convolutional text classifier for toxicity, trained in numpy and applied to whole texts.

Words are hashed to embeddings (the word and its beginning, added up); filters of
several widths slide over them and each keeps its strongest response in a text.
The model has a fixed size and is fitted on all labelled rows: each task goes over
its shard of them once from the same network, the changes are averaged by embedding,
over the shards that moved it, and the next round starts from there.
A second small model guesses a text's language, and the raw score is shifted so
that each language's own threshold, chosen over all labelled rows, comes to lie at THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.llm.buffers import LOWER, hashes, packed, runs, slices, text_bytes

THRESHOLD = 0.7
SHARD_ROWS, SHARD_BYTES = 4096, 64 << 20  # labelled rows in a shard, and bytes of all texts per shard, about
BROADCAST_ROWS = 200_000  # labels (two numbers) that go to the texts at most; more are joined by a shuffle
BUCKETS, SIZE, START_BYTES = 1 << 17, 8, 4
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 8, 64, 0.08
DROPPED = 0.5  # share of all words that a training step does not see, so that each word must count by itself
LANGUAGE_BUCKETS = 1 << 12
LEAST_ROWS = 15  # of each class, for a threshold of a language's own
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_PAD = max(WIDTHS) - 1
_SHAPES = [(w * SIZE, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(len(WIDTHS) * FILTERS,), (1,)]
_ROWS = BUCKETS + -(-sum(int(np.prod(s)) for s in _SHAPES) // SIZE)
FIXED, MOST = 2.0**32, 2.0**16  # changes are added up as whole numbers, so that their order does not matter
CUTS = 256  # places for a threshold per unit of the raw score, where rows are counted and not listed


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, hashed beginnings of words, and each text's first word (n+1 offsets)."""
    data, offsets = text_bytes(column)
    low = LOWER[data]
    start, end, first = runs(_WORD[data], offsets)
    word = (hashes(low, start, end) % np.uint64(BUCKETS)).astype(np.int32)
    begin = (hashes(low, start, np.minimum(end, start + START_BYTES), 1) % np.uint64(BUCKETS)).astype(np.int32)
    return word, begin, first


def _parts(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Embeddings, filters and their offsets by width, weights and offset of the output layer: views of one matrix."""
    flat, views, at = rows[BUCKETS:].reshape(-1), [], 0
    for shape in _SHAPES:
        size = int(np.prod(shape))
        views.append(flat[at : at + size].reshape(shape))
        at += size
    n = len(WIDTHS)
    return rows[:BUCKETS], views[:n], views[n : 2 * n], views[-2], views[-1]


@dataclass
class Network:
    """All weights as one matrix, embeddings first."""

    rows: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        network = cls(np.zeros((_ROWS, SIZE), np.float32))
        table, filters, _, out, _ = _parts(network.rows)
        table[:] = rng.normal(0, 0.1, table.shape)
        for f in filters:
            f[:] = rng.normal(0, 0.4, f.shape)
        out[:] = rng.normal(0, 0.3, out.shape)
        return network

    def _laid_out(self, word, begin, first):
        """Word vectors with zeros after each text, and where each text starts."""
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        at = np.arange(len(word)) + text * _PAD
        x = np.zeros((len(word) + n * _PAD + _PAD, SIZE), np.float32)
        table = self.rows[:BUCKETS]
        x[at] = table[word] + table[begin]
        return x, at, text, first[:-1] + np.arange(n) * _PAD

    def _responses(self, x, at, width):
        _, filters, bias, _, _ = _parts(self.rows)
        k = WIDTHS.index(width)
        rows = len(x) - _PAD
        out = np.zeros((rows, FILTERS), np.float32)
        total = bias[k] + sum(x[s : rows + s] @ filters[k][s * SIZE : (s + 1) * SIZE] for s in range(width))
        out[at] = np.maximum(total[at], 0)
        return out

    def logits(self, word, begin, first) -> np.ndarray:
        x, at, _, start = self._laid_out(word, begin, first)
        pooled = [np.maximum.reduceat(self._responses(x, at, w), start, axis=0) for w in WIDTHS]
        _, _, _, out, base = _parts(self.rows)
        return np.concatenate(pooled, axis=1) @ out + base[0]

    def step(self, word, begin, first, label, weight, memory: np.ndarray) -> np.ndarray:
        """One Adagrad step with its squares in `memory`; the embeddings it moved. Only the strongest place of a filter in a text has a gradient."""
        table, filters, bias, weights, base = _parts(self.rows)
        seen_table, seen_filters, seen_bias, seen_weights, seen_base = _parts(memory)
        x, at, text, start = self._laid_out(word, begin, first)
        n = len(first) - 1
        source = np.full(len(x), -1)
        source[at] = np.arange(len(word))
        pooled, places = [], []
        for w in WIDTHS:
            r = self._responses(x, at, w)
            best = np.maximum.reduceat(r, start, axis=0)
            rows, cols = np.nonzero((r[at] == best[text]) & (r[at] > 0))
            key, one = np.unique(text[rows] * FILTERS + cols, return_index=True)
            pooled.append(best)
            places.append((key // FILTERS, key % FILTERS, at[rows[one]]))
        p = np.concatenate(pooled, axis=1)
        d = ((1 / (1 + np.exp(-(p @ weights + base[0]))) - label) * weight / n).astype(np.float32)
        rows_of, grads = [], []
        out = weights.copy()
        for k, (w, (doc, col, place)) in enumerate(zip(WIDTHS, places, strict=True)):
            g = d[doc] * out[k * FILTERS + col]
            change = np.zeros_like(filters[k])
            for s in range(w):
                np.add.at(change.T, (col[:, None], np.arange(s * SIZE, (s + 1) * SIZE)[None]), g[:, None] * x[place + s])
                word_at = source[place + s]
                own = word_at >= 0
                rows_of.append(word_at[own])
                grads.append((g[:, None] * filters[k][s * SIZE : (s + 1) * SIZE, col].T)[own])
            self._move(filters[k], change + 1e-5 * filters[k], seen_filters[k])
            self._move(bias[k], np.bincount(col, g, FILTERS).astype(np.float32), seen_bias[k])
        self._move(weights, p.T @ d + 1e-5 * weights, seen_weights)
        self._move(base, np.array([d.sum()], np.float32), seen_base)
        rows, grad = np.concatenate(rows_of), np.concatenate(grads)
        ids, back = np.unique(np.concatenate((word[rows], begin[rows])), return_inverse=True)
        total = np.zeros((len(ids), SIZE), np.float32)
        np.add.at(total, back, np.concatenate((grad, grad)))
        seen_table[ids] += total**2
        table[ids] -= RATE * total / np.sqrt(seen_table[ids] + 1e-8)
        return ids

    @staticmethod
    def _move(value, grad, seen) -> None:
        seen += grad**2
        value -= RATE * grad / np.sqrt(seen + 1e-8)


@dataclass
class Classifier:
    network: Network
    languages: list[str]
    language_weights: np.ndarray  # log share of each beginning in each language
    cut: np.ndarray  # raw threshold of each language
    slope: float = 1.5

    def guess(self, begin, first) -> np.ndarray:
        """Each text's language by the beginnings of its words."""
        totals = np.zeros((len(self.languages), len(begin) + 1))
        np.cumsum(self.language_weights[:, begin % LANGUAGE_BUCKETS], axis=1, out=totals[:, 1:])
        return np.argmax(totals[:, first[1:]] - totals[:, first[:-1]], axis=0)

    def scores(self, word, begin, first) -> tuple[np.ndarray, np.ndarray]:
        """(score, language index) per text."""
        language = self.guess(begin, first)
        z = self.slope * (self.network.logits(word, begin, first).astype(np.float64) - self.cut[language])
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60))), language


def threshold_of(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The raw score that parts the classes with the fewest errors, midway between its neighbours; `y` of `n` rows (of one) at each `z` are of class 1."""
    z, back = np.unique(z, return_inverse=True)
    above = np.bincount(back, y, len(z))
    below = np.bincount(back, (1 if n is None else n) - y, len(z))
    wrong = np.concatenate(([0], np.cumsum(above))) + np.concatenate((np.cumsum(below[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    return float((edges[k] + edges[k + 1]) / 2)


def _joined(word: list[np.ndarray], begin: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.concatenate([word[i] for i in rows]), np.concatenate([begin[i] for i in rows]),
            np.concatenate(([0], np.cumsum([len(word[i]) for i in rows]))))


def _weights(label: np.ndarray, counts: tuple[int, int]) -> np.ndarray:
    """Both classes weigh the same, by how many rows of class 0 and 1 there are."""
    return np.where(label == 1, sum(counts) / (2 * counts[1]), sum(counts) / (2 * counts[0]))


def _rounds(counts: tuple[int, int]) -> int:
    return EPOCHS if sum(counts) > 1000 else 4 * EPOCHS


def go_over(network: Network, memory: np.ndarray, word: list[np.ndarray], begin: list[np.ndarray], label: np.ndarray,
            weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All rows once, in random order; how many steps moved each row of the network's matrix."""
    steps = np.zeros(_ROWS, np.int64)
    order = rng.permutation(len(label))
    for k in range(0, len(order), BATCH):
        rows = order[k : k + BATCH]
        w, b, first = _joined(word, begin, rows)
        seen = (rng.random(BUCKETS) >= DROPPED)[w]
        left = np.concatenate(([0], np.cumsum(seen)))[first]
        steps[network.step(w[seen], b[seen], left, label[rows], weight[rows], memory)] += 1
        steps[BUCKETS:] += 1
    return steps


def _classifier(network: Network, names: list[str], counts: np.ndarray) -> Classifier:
    """Without thresholds; `counts`: how often each beginning occurs in each language."""
    smooth = counts + 0.5
    return Classifier(network, names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32), np.zeros(len(names)))


def _raw(model: Classifier, word: list[np.ndarray], begin: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Raw score and guessed language of each row."""
    z, guess = np.zeros(len(word)), np.zeros(len(word), np.int64)
    for k in range(0, len(word), BATCH):
        rows = np.arange(k, min(k + BATCH, len(word)))
        w, b, first = _joined(word, begin, rows)
        z[rows], guess[rows] = model.network.logits(w, b, first), model.guess(b, first)
    return z, guess


def _set_thresholds(model: Classifier, guess: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
    """A threshold for each language with enough rows of both classes, one for the rest; `y` of `n` rows at each `z` are of class 1."""
    common = threshold_of(z, y, n)
    for k in range(len(model.languages)):
        own = guess == k
        enough = min(y[own].sum(), (n - y)[own].sum()) >= LEAST_ROWS
        model.cut[k] = threshold_of(z[own], y[own], n[own]) if enough else common


def _language_counts(begin: list[np.ndarray], language: list[str], names: list[str]) -> np.ndarray:
    at, counts = {name: k for k, name in enumerate(names)}, np.zeros((len(names), LANGUAGE_BUCKETS))
    for b, name in zip(begin, language, strict=True):
        counts[at[name]] += np.bincount(b % LANGUAGE_BUCKETS, minlength=LANGUAGE_BUCKETS)
    return counts


def fit(word: list[np.ndarray], begin: list[np.ndarray], label: np.ndarray, language: list[str]) -> Classifier | None:
    """A classifier from the tokenised texts of one shard; None unless both classes occur."""
    if not len(label) or label.min() == label.max():
        return None
    rng, network, memory = np.random.default_rng(11), Network.new(), np.zeros((_ROWS, SIZE), np.float32)
    counts = (int((label == 0).sum()), int((label == 1).sum()))
    for _ in range(_rounds(counts)):
        go_over(network, memory, word, begin, label, _weights(label, counts), rng)
    names = sorted(set(language))
    model = _classifier(network, names, _language_counts(begin, language, names))
    z, guess = _raw(model, word, begin)
    _set_thresholds(model, guess, z, label, np.ones(len(label)))
    return model


def _unpacked(column) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed words and beginnings of each text, which are stored in pairs: a repeated word is then one repetition of bytes to a compressor."""
    pairs = [np.frombuffer(b, np.int32).reshape(-1, 2) for b in column.to_pylist()]
    return [p[:, 0] for p in pairs], [p[:, 1] for p in pairs]


_CHANGES = [f"{kind}{k}" for kind in ("value", "square") for k in range(SIZE)]


def _round(shards: DataFrame, network: Network, memory: np.ndarray, counts: tuple[int, int], number: int) -> None:
    """Every shard goes over its rows once from `network`, which then moves by the mean of its changes.

    A row of the matrix is averaged over the shards that moved it, each by its number of steps there, and so are its squares.
    """
    rows = network.rows

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, begin, label, key = [], [], [], 0
        for batch in batches:
            some = _unpacked(batch.column("words"))
            word += some[0]
            begin += some[1]
            label += batch.column("toxic").to_pylist()
            key = batch.column("shard")[0].as_py()
        if not label:
            return
        own, squares, y = Network(rows.copy()), memory.copy(), np.array(label, np.float64)
        steps = go_over(own, squares, word, begin, y, _weights(y, counts), np.random.default_rng([11, number, key]))
        moved = np.flatnonzero(steps)
        change = np.concatenate((own.rows[moved] - rows[moved], np.minimum(squares[moved] - memory[moved], MOST)), axis=1).astype(np.float64)
        whole = np.rint(change * FIXED * steps[moved, None]).astype(np.int64)
        yield pa.record_batch([pa.array(moved.astype(np.int32)), pa.array(steps[moved]), *(pa.array(c) for c in whole.T)], ["row", "steps", *_CHANGES])

    got = shards.select("shard", "toxic", "words").mapInArrow(changes, ", ".join(["row int", "steps long", *(f"{c} long" for c in _CHANGES)]))
    # at most as many rows as the network has, however many shards there are
    total = got.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("steps", *_CHANGES))).toArrow()
    at, steps = total.column("row").to_numpy(), total.column("steps").to_numpy()
    mean = np.stack([total.column(c).to_numpy() for c in _CHANGES], axis=1) / (FIXED * steps[:, None])
    network.rows[at] += mean[:, :SIZE].astype(np.float32)
    memory[at] += mean[:, SIZE:].astype(np.float32)


def _fit_shards(shards: DataFrame) -> Classifier | None:
    """As `fit`, over all shards; the driver gets sums of a size that the network and the languages set."""
    found = {r["toxic"]: r["count"] for r in shards.groupBy("toxic").count().collect()}  # two rows at most
    if len(found) < 2:
        return None
    counts, network, memory = (found[0], found[1]), Network.new(), np.zeros((_ROWS, SIZE), np.float32)
    for number in range(_rounds(counts)):
        _round(shards, network, memory, counts, number)

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column("lang").to_pylist()
            names = sorted(set(language))
            total = _language_counts(_unpacked(batch.column("words"))[1], language, names).astype(np.int64)
            some, bucket = np.nonzero(total)
            yield pa.record_batch([pa.array([names[k] for k in some], pa.string()), pa.array(bucket.astype(np.int32)), pa.array(total[some, bucket])],
                                  ["lang", "bucket", "n"])

    names = sorted(r["lang"] for r in shards.select("lang").distinct().collect())
    # one number per language and bucket
    got = shards.select("lang", "words").mapInArrow(beginnings, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total, place = np.zeros((len(names), LANGUAGE_BUCKETS)), {name: k for k, name in enumerate(names)}
    total[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    model = _classifier(network, names, total)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, guess = _raw(model, *_unpacked(batch.column("words")))
            cut = np.clip(np.floor(z * CUTS), -128 * CUTS, 128 * CUTS).astype(np.int32)
            yield pa.record_batch([pa.array(guess), pa.array(cut), batch.column("toxic").cast(pa.int64())], ["guess", "cut", "toxic"])

    # at most 65,537 places per language
    got = shards.select("toxic", "words").mapInArrow(scored, "guess long, cut int, toxic long").groupBy("guess", "cut").agg(
        F.sum("toxic").alias("y"), F.count("*").alias("n")).toArrow()
    guess, cut, y, n = (got.column(c).to_numpy().astype(np.float64) for c in ("guess", "cut", "y", "n"))
    _set_thresholds(model, guess, (cut + 0.5) / CUTS, y, n)
    return model


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Classifier | None:
    """Fit on all labelled rows (doc_id, toxic) with their whole texts, in shards of about `shard_rows` rows.

    Rows without a label, an id or a text are not used. `lang` only trains the language guess. One shard is fitted
    on the driver; the rows of more stay on the executors.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = known.count()
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = max(1, -(-labelled // shard_rows), -(-size // SHARD_BYTES))
    texts = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).filter("text is not null")
    rows = texts.join(F.broadcast(known) if labelled <= BROADCAST_ROWS else known, "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            word, begin, first = word_ids(batch.column("text"))
            pairs = np.stack((word, begin), axis=1)
            words = pa.array([packed(pairs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in ("key", "toxic", "lang")), words], ["key", "toxic", "lang", "words"])

    cut = rows.select("key", "text", "toxic", "lang").mapInArrow(tokens, "key long, toxic int, lang string, words binary")
    if shards == 1:
        got = cut.toArrow().sort_by("key")
        return fit(*_unpacked(got.column("words")), got.column("toxic").to_numpy().astype(np.float64), got.column("lang").to_pylist())
    shard = F.pmod("key", F.lit(shards)).cast("int")
    dealt = cut.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("key").persist(StorageLevel.DISK_ONLY)
    try:
        return _fit_shards(dealt)
    finally:
        dealt.unpersist()


def score_toxicity(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """`docs` with `score` (0 to 1, from the whole text), `rejected` (score >= THRESHOLD) and `guessed_lang`.

    Null and empty texts are scored as texts without words. Without a model
    (no labels, or of one class only) every score is 0. Other columns stay; columns
    of the three names are replaced.
    """
    docs = docs.drop("score", "rejected", "guessed_lang")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in slices(b)):
            if model is None:
                score, language = np.zeros(len(batch)), [None] * len(batch)
            else:
                score, guess = model.scores(*word_ids(batch.column("text")))
                language = [model.languages[g] for g in guess]
            yield pa.record_batch(
                [*batch.columns, pa.array(score), pa.array(score >= THRESHOLD), pa.array(language, pa.string())],
                [*names, "score", "rejected", "guessed_lang"])

    schema = docs.withColumns({"score": F.lit(0.0), "rejected": F.lit(True), "guessed_lang": F.lit(None).cast("string")}).schema
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
