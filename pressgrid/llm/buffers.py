"""Texts of a record batch as one byte buffer, with words and lines as offset arrays.

Hashes are polynomials taken from running sums, so a whole batch is hashed with a
few array passes and no Python loop over words. `hashes` is modulo 2**64 and serves
features, where a collision does no harm; what tells texts apart is `field_hashes`,
modulo a prime, where no pair of texts collides for all bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text; one longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(size)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and where each text starts and ends (n+1 offsets); a null text counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(filled):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    filled = pa.concat_arrays([filled])  # a slice starts anew
    at = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within a text: starts, ends, and each text's first run (n+1 offsets)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray, kind: int = 0) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word."""
    v = values ^ (values >> np.uint64(31))
    v = v * np.uint64(_MIX[kind])
    v ^= v >> np.uint64(29)
    v = v * np.uint64(_MIX[1 - kind])
    return v ^ (v >> np.uint64(32))


def _powers_of(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        base, size = _BASE[kind], max(n, 1 << 16)
        tables = []
        for step in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p))
        have = (tables[0], tables[1])
        if n <= 4 * BATCH_BYTES:
            _powers[kind] = have
    return have


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """64-bit hash of each byte range; `kind` 0 and 1 are independent."""
    up, down = _powers_of(kind, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts], kind)


PRIME = (1 << 31) - 1
SUM_BYTES = 1 << 24  # so many terms below 2**39 add up below 2**63
_bases = np.random.default_rng(0x5EED).integers(1 << 16, PRIME - 1, (2, 2)).tolist()  # drawn at random once; per kind two
_field: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _field_powers(kind: int, lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME, at least n of them, in 32 bits each."""
    have = _field.get((kind, lane))
    if have is None or len(have[0]) < n:
        base, size = _bases[kind][lane], max(n, 1 << 16)
        tables = []
        for step in (base, pow(base, -1, PRIME)):
            p = np.ones(size, np.uint32)
            done = 1
            while done < size:
                more = min(done, size - done)
                p[done : done + more] = p[:more] * np.uint64(pow(step, done, PRIME)) % np.uint64(PRIME)
                done += more
            tables.append(p)
        have = (tables[0], tables[1])
        if n <= 2 * BATCH_BYTES:
            _field[kind, lane] = have
    return have


def field_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
    """62-bit hash of each byte range, spread over 64 bits: two polynomials modulo a prime; `kind` 0 and 1 are independent."""
    prime = np.uint64(PRIME)
    out = np.zeros(len(starts), np.uint64)
    letters = data.astype(np.uint16) + np.uint16(1)
    total = np.zeros(len(data) + 1, np.uint64)
    for lane in (0, 1):
        up, down = _field_powers(kind, lane, len(data) + 1)
        for a in range(0, len(data), SUM_BYTES):
            b = min(a + SUM_BYTES, len(data))
            np.multiply(letters[a:b], up[a:b], out=total[a + 1 : b + 1], dtype=np.uint64)
            np.cumsum(total[a + 1 : b + 1], out=total[a + 1 : b + 1])
            if a:
                total[a + 1 : b + 1] += total[a] % prime
        if len(data) <= SUM_BYTES:  # one run of sums that only grow
            v = (total[ends] - total[starts]) % prime
        else:
            v = (total[ends] % prime + prime - total[starts] % prime) % prime
        v = v * down[starts] % prime
        out = out << np.uint64(31) | v
    return mixed(out, kind)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, split at white space) and each text's first word (n+1 offsets)."""
    data, offsets = text_bytes(column)
    starts, ends, first = runs(~SPACE[data], offsets)
    return field_hashes(LOWER[data], starts, ends), first


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
