"""SentencePiece ids by a streaming Viterbi search, and back.

The best segmentation of a text is built left to right: each place keeps the one
piece that can end there after the best segmentation up to that piece's start.
A piece may follow another if merging the two pieces' characters, best score
first, gives the two pieces again; so the ids are those of the model's own
merges. Only as many places as the longest piece has characters are kept; ids
are given out as soon as the paths of all kept places share a boundary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressgrid.llm.buffers import slices

SPACE = "▁"
CACHE_WORDS, CACHE_LENGTH = 450_000, 32
PREFIXES, CACHE_BEGUN = (4, 6, 8), 80_000  # lengths of word beginnings whose search is kept, and how many
MARKS = """.,;:!?"()\n"""
_START = -1
_loaded: dict[str, Pieces] = {}


class Pieces:
    """A BPE SentencePiece model with byte fallback, read from its file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in plain}
        self.text = {k: p for p, k in self.ids.items()}
        self.score = {p: model.get_score(k) for p, k in self.ids.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {k: b for b, k in enumerate(self.byte)}
        self.longest = max(map(len, self.ids))
        self.ended = {p[k:]: -1 for p in self.ids for k in range(1, len(p))} | self.ids  # every end of a piece; -1 where it is none itself
        self._begun: dict[str, tuple[int, ...]] = {}
        self._spines: dict[int, tuple[list[tuple[str, float]], list[tuple[str, float]]] | None] = {}
        written = {k: p.replace(SPACE, " ").encode() for k, p in self.text.items()} | {k: bytes([b]) for k, b in self.of_byte.items()}
        self._written = pa.array([written.get(k, b"") for k in range(size + 1)], pa.large_binary())  # the last one for ids out of range
        self._is_part = np.zeros(size + 1, bool)  # bytes that are no character by themselves
        self._is_part[self.byte[128:]] = True
        # where no piece goes on, a text may be cut: before spaces, and before some punctuation
        self._inner = inner = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        if any(b == SPACE != a for a, b in inner):
            raise ValueError("pieces must not hold a space after another character")
        marks = "".join(c for c in MARKS if not any(b == c and a != SPACE and a not in MARKS for a, b in inner))
        ends = re.escape(marks)
        self._cut = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}*[{ends}]+[^{SPACE}{ends}]*|{SPACE}+" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._follows: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether merging keeps the two pieces apart and whole; `left` is _START where there is none."""
        known = self._follows.get((left + 1) * self.size + right)
        if known is None:
            known = self._apart(left, right)
            self._follows[(left + 1) * self.size + right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Follows the parts on both sides of the boundary as they grow, the best score first: no merge across it may come before their own."""
        a = self._edges(left) if left != _START else None
        b = self._edges(right)
        if b is None or (left != _START and a is None):  # merges out of order: all of them are done
            word = self.text[right] if left == _START else self.text[left] + self.text[right]
            return self._merged(word) == ([self.text[right]] if left == _START else [self.text[left], self.text[right]])
        if left == _START:
            return True
        ends, begins = a[1], b[0]
        i = j = 0
        while True:
            across = self.score.get(ends[i][0] + begins[j][0], -np.inf)
            grown_left = ends[i + 1][1] if i + 1 < len(ends) else -np.inf
            grown_right = begins[j + 1][1] if j + 1 < len(begins) else -np.inf
            if across > -np.inf and across > grown_left and across >= grown_right:  # of equal scores the one to the left comes first
                return False
            if grown_left == grown_right == -np.inf:
                return True
            if grown_left >= grown_right:
                i += 1
            else:
                j += 1

    def _edges(self, piece: int) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The parts at a piece's beginning and at its end, from one character to the piece, with the scores they are merged at.

        None where the piece does not come out of its own merges, or these do not come in the order of their scores.
        """
        if piece not in self._spines:
            text = self.text[piece]
            parts, begins, ends, before = list(text), [(text[0], np.inf)], [(text[-1], np.inf)], np.inf
            found = None
            while True:
                scored = [(self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                if not scored:
                    found = (begins, ends)
                    break
                best, k = max(scored)
                if best == -np.inf or best > before:
                    break
                k, before = -k, best
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if k == 0:
                    begins.append((parts[0], best))
                if k == len(parts) - 1:
                    ends.append((parts[-1], best))
            self._spines[piece] = found
        return self._spines[piece]

    def _merged(self, word: str) -> list[str]:
        parts = list(word)
        while True:
            scored = [(self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            if not scored or max(scored)[0] == -np.inf:
                return parts
            k = -max(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed 32-bit integers."""
        if not text:
            return b""
        words, out = self._words, []
        for word in self._cut(SPACE + text.replace(" ", SPACE)):
            ids = words.get(word)
            out.append(self._new(word) if ids is None else ids)
        return b"".join(out)

    def _new(self, word: str) -> bytes:
        """Ids of a word that was not met before; marks at its end that no piece joins to the rest are cut off."""
        end = len(word)
        while end > 1 and word[end - 1] in MARKS and word[end - 2] != SPACE and (word[end - 2], word[end - 1]) not in self._inner:
            end -= 1
        if end < len(word):  # none of the parts has such a mark itself
            return b"".join(self._words.get(part) or self._new(part) for part in (word[:end], *word[end:]))
        ids = np.array(self._short(word) or list(self.stream(word)), np.int32).tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            self._words[word] = ids
        return ids

    def _short(self, word: str) -> list[int] | None:
        """As `stream`, for a word that fits the window and has known characters only.

        What was found for a word's first characters holds for all words that begin so, and is kept.
        """
        size = len(word)
        if size > CACHE_LENGTH:
            return None
        last = None
        for known in reversed(PREFIXES):
            if known < size:
                last = self._begun.get(word[:known])
                if last is not None:
                    last = list(last)
                    break
        if last is None:
            last = [_START]
        ended, pairs, step = self.ended.get, self._follows.get, self.size
        for end in range(len(last), size + 1):
            start, fitting = end - 1, []
            while start >= 0:
                piece = ended(word[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    fitting.append((start, piece))
                start -= 1
            for start, piece in reversed(fitting):  # the longest first
                left = last[start]
                fits = pairs((left + 1) * step + piece)
                if fits is None:
                    fits = self.follows(left, piece)
                if fits:
                    last.append(piece)
                    break
            else:
                return None
            if end in PREFIXES and end < size:
                if len(self._begun) >= CACHE_BEGUN:
                    self._begun.clear()
                self._begun[word[:end]] = tuple(last)
        return self._path(word, last, size)

    def stream(self, characters) -> Iterator[int]:
        """Ids of a run of characters, given out as soon as they are certain."""
        window = ""  # characters since the last certain boundary
        last: list[int] = [_START]  # for each place of the window, the piece that ends there
        before = _START  # the piece that ends at the window's start
        for character in characters:
            if character not in self.ids:  # merges with nothing: a certain boundary
                yield from self._path(window, last, len(window))
                yield from (self.byte[b] for b in character.encode("utf-8", "surrogatepass"))
                window, last, before = "", [_START], _START
                continue
            window += character
            end = len(window)
            for length in range(min(self.longest, end), 0, -1):
                piece = self.ids.get(window[end - length :])
                if piece is not None and self.follows(last[end - length] if end > length else before, piece):
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no piece can end after {window!r}")
            if end >= 2 * self.longest:
                shared = self._shared(window, last)
                if shared:
                    yield from self._path(window, last, shared)
                    before = last[shared]
                    window, last = window[shared:], [before, *last[shared + 1 :]]
        yield from self._path(window, last, len(window))

    def _path(self, window: str, last: list[int], end: int) -> list[int]:
        ids = []
        while end:
            ids.append(last[end])
            end -= len(self.text[last[end]])
        return ids[::-1]

    def _shared(self, window: str, last: list[int]) -> int:
        """The last boundary that the paths of all places a piece may still start from have in common."""
        alive = set(range(len(window) - self.longest + 1, len(window) + 1))
        while len(alive) > 1:
            end = max(alive)
            alive.remove(end)
            alive.add(end - len(self.text[last[end]]))
        return alive.pop()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of many lists of ids: the bytes of their pieces, taken at once; bytes that are no UTF-8 become U+FFFD."""
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        taken = self._written.take(pa.array(known))  # the pieces' bytes lie one behind the other
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        data = np.frombuffer(taken.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        at = ends[offsets - offsets[0]] - ends[0]
        # the space before the first word goes
        lead = np.zeros(len(at) - 1, np.int64)
        some = at[1:] > at[:-1]
        lead[some] = data[at[:-1][some]] == 32
        kept = np.delete(data, at[:-1][lead == 1])
        bounds = at - np.concatenate(([0], np.cumsum(lead)))
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lead), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(kept.tobytes())])
        parts = np.concatenate(([0], np.cumsum(self._is_part[known])))[offsets - offsets[0]]
        odd = np.diff(parts) > 0
        if odd.any():
            read = [kept[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace").encode() for k in np.flatnonzero(odd)]
            binary = pc.replace_with_mask(binary, pa.array(odd), pa.array(read, pa.large_binary()))
        return binary.cast(pa.large_string()).cast(pa.string())


def load(path: str) -> Pieces:
    """The model of a file, once per Python worker; words it has met are kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _with(docs: DataFrame, **columns: T.DataType) -> tuple[DataFrame, T.StructType]:
    docs = docs.drop(*columns)
    return docs, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in columns.items())])


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """`docs` with `ids` (array of int), `n_ids` and `ids_crc32` of the whole text, by the model file `model`.

    A null or empty text has no ids. Other columns stay; columns of the three
    names are replaced. Rows are independent; an empty table stays empty.
    """
    docs, schema = _with(docs, ids=T.ArrayType(T.IntegerType()), n_ids=T.LongType(), ids_crc32=T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in (p for b in batches for p in slices(b)):
            packed = [pieces.encode(t or "") for t in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.record_batch([
                *batch.columns, pa.ListArray.from_arrays(pa.array(offsets), flat),
                pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(p) for p in packed], pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """`rows` with `decoded`, the text of `ids`; null ids count as none."""
    rows, schema = _with(rows, decoded=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            flat = pc.fill_null(ids.values[at[0] : at[-1]] if len(at) else ids.values, -1).to_numpy(zero_copy_only=False)
            yield pa.record_batch([*batch.columns, pieces.decode(flat, at)], schema.names)

    return rows.mapInArrow(run, schema)


def same_text() -> Column:
    """Whether decoding gave the text back; the model has one mark for spaces and U+2581."""
    return F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
