"""Order-preserving packing of token streams into windows of fixed length.

Each task packs the stream of its documents. A dynamic program over possible
cuts (document ends, sentence ends, and points between them) minimises padding
plus a penalty for what a cut breaks; because padding is linear in the window's
start, the best earlier cut is the front of a monotone queue. Texts are not
shuffled.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.buffers import slices

SENTENCE_CUT, INNER_CUT = 1, 4  # in tokens of padding; the end of a document costs nothing
INNER_STEP = 8  # a sentence may be cut after every so many of its tokens
SHORT_COST = 16  # of a sequence whose length is a smaller power of two
RUN_TOKENS = 1 << 18
LONG_SPACE = 1 << 17  # white space in a row that is left to the slower encoder; from about 1,000,000 the other one fails
END = b"\0\0\0\0"  # id 0 ends a document


class Encoder:
    """Ids of a byte-level BPE tokenizer, read from its JSON file and the rank file of the same name.

    The rank file's encoder is faster and gives the same ids, but for texts that
    hold an added token or very long white space; those are encoded by the JSON file.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        import tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = tokenizers.Tokenizer.from_file(str(PurePath(path).with_suffix(".json")))
        added = self._whole.get_added_tokens_decoder()
        self._added = [token.content for token in added.values()]
        size = max([*ranks.values(), *added]) + 1
        self.ends, self.breaks, self.spaced = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        for piece, rank in ranks.items():
            self.ends[rank] = piece.rstrip(b"\"')")[-1:] in (b".", b"!", b"?")
            self.breaks[rank] = b"\n" in piece
            self.spaced[rank] = piece[:1] in (b" ", b"\n")

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self._added) or (
                len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text))):
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast(text)
        return np.array(ids, np.uint32).tobytes()

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places after a full stop that white space follows, and after line breaks."""
        stop = self.ends[ids]
        stop[:-1] &= self.spaced[ids[1:]]
        return np.flatnonzero(stop | self.breaks[ids]) + 1


def best_cuts(place: list[int], penalty: list[int], window: int, powers: bool) -> list[int]:
    """Places at which to cut, the last one included, at the least padding plus penalties.

    `place` rises from the stream's start (0) to its end by steps of at most
    `window`. With `powers`, a sequence as long as a smaller power of two needs
    no padding and costs SHORT_COST.
    """
    n = len(place)
    value = [0] * n  # cost + place: what the monotone queue orders
    back = [0] * n
    queue = [0] * n
    head, tail = 0, 1
    sizes = [1 << k for k in range((window - 1).bit_length())] if powers else []
    index = {p: k for k, p in enumerate(place)} if powers else {}
    for k in range(1, n):
        p = place[k]
        least = p - window
        while place[queue[head]] < least:
            head += 1
        from_ = queue[head]
        cost = value[from_] + window - p
        for size in sizes:
            j = index.get(p - size)
            if j is not None and (other := value[j] - place[j] + SHORT_COST) < cost:
                cost, from_ = other, j
        back[k] = from_
        own = cost + penalty[k] + p
        value[k] = own
        while tail > head and value[queue[tail - 1]] >= own:
            tail -= 1
        queue[tail] = k
        tail += 1
    out, k = [], n - 1
    while k:
        out.append(place[k])
        k = back[k]
    return out[::-1]


class _Stream:
    """Tokens that wait to be packed, and the documents they belong to."""

    def __init__(self, encoder: Encoder, window: int, with_ids: bool):
        self.encoder, self.window, self.with_ids = encoder, window, with_ids
        self.waiting: list[bytes] = []
        self.tokens = 0
        self.docs: list[list] = []  # doc_id, where it starts (may lie before the waiting tokens), tokens
        self.sequence = TaskContext.get().partitionId() << 33

    def add(self, doc_id, text: str | None) -> None:
        ids = self.encoder(text or "") + END
        self.docs.append([doc_id, self.tokens, len(ids) // 4])
        self.waiting.append(ids)
        self.tokens += len(ids) // 4

    def pack(self, final: bool) -> pa.RecordBatch:
        """Pieces of all finished sequences; unless this is the end, the last window waits for more text."""
        ids = np.frombuffer(b"".join(self.waiting), np.uint32)
        ends = np.array([d[1] + d[2] for d in self.docs], np.int64)
        sentences = self.encoder.sentence_ends(ids)
        marks = np.unique(np.concatenate(([0], sentences, ends)))
        gaps = np.diff(marks)
        inner = (gaps - 1) // INNER_STEP
        fill = np.repeat(marks[:-1], inner) + INNER_STEP * (
            np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner) + 1)
        place = np.concatenate((marks, fill))
        penalty = np.full(len(place), INNER_CUT)
        penalty[: len(marks)] = np.where(np.isin(marks, ends), 0, SENTENCE_CUT)
        order = np.argsort(place, kind="stable")
        cuts = best_cuts(place[order].tolist(), penalty[order].tolist(), self.window, False)
        if final:  # no text is left to fill a window: shorter sequences may end the stream
            tail = cuts[-2] if len(cuts) > 1 else 0
            at, cost = place[order], penalty[order]
            own = at >= tail
            cuts = cuts[:-1] + [tail + c for c in best_cuts((at[own] - tail).tolist(), cost[own].tolist(), self.window, True)]
        else:
            cuts = cuts[:-2]
        batch = self._pieces(ids, ends, np.array(cuts, np.int64))
        done = cuts[-1] if cuts else 0
        self.sequence += len(cuts)
        self.docs = [[d[0], d[1] - done, d[2]] for d, e in zip(self.docs, ends.tolist(), strict=True) if e > done]
        self.waiting, self.tokens = [ids[done:].tobytes()], len(ids) - done
        return batch

    def _pieces(self, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        done = cuts[-1] if len(cuts) else 0
        edges = np.unique(np.concatenate(([0], cuts, ends[ends < done])))
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, start, "right")
        sequence = np.searchsorted(cuts, start, "right")
        begin = np.concatenate(([0], cuts))[sequence]
        first = np.array([d[1] for d in self.docs], np.int64)
        total = np.array([d[2] for d in self.docs], np.int64)
        view = memoryview(ids.tobytes())
        parts = [view[4 * a : 4 * b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        columns = [
            pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()), pa.array(start - first[doc]), pa.array(stop - start),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(total[doc]),
            pa.array(self.sequence + sequence), pa.array(start - begin)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            columns.append(pa.array([np.frombuffer(p, np.int32) for p in parts], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(columns, names)


def pack_documents(
    docs: DataFrame, ranks: str, pattern: str, window: int = 1024, with_ids: bool = True,
) -> DataFrame:
    """Pieces of the documents' token streams (ids of the text, then id 0), packed into sequences of at most `window`.

    `ranks` is the path of a byte-level BPE rank file, `pattern` its splitting
    pattern; the tokenizer's JSON file lies beside it. Documents keep the order of `docs` within each partition; a piece is
    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, when
    asked for, ids). A null or empty text is one token. Each row is a document of
    its own, whatever its doc_id (null included). Other columns are ignored; an
    empty table gives no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(Encoder(ranks, pattern), window, with_ids)
        for batch in (p for b in batches for p in slices(b)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                stream.add(doc_id, text)
                if stream.tokens >= RUN_TOKENS:
                    yield stream.pack(False)
        if stream.tokens:
            yield stream.pack(True)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
