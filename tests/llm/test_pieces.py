"""Parts of the SentencePiece operator against plain forms."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pressgrid.llm.pieces import PREFIXES, Pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


def slow(pieces, ids):
    """Piece by piece, runs of bytes as one."""
    out, raw = [], bytearray()
    for k in ids:
        if k in pieces.of_byte:
            raw.append(pieces.of_byte[k])
            continue
        out.append(raw.decode("utf-8", "replace"))
        raw.clear()
        out.append(pieces.text.get(k, ""))
    text = "".join([*out, raw.decode("utf-8", "replace")]).replace("▁", " ")
    return text[1:] if text[:1] == " " else text


def decoded(pieces, lists):
    flat = np.array([k for ids in lists for k in ids], np.int32)
    return pieces.decode(flat, np.concatenate(([0], np.cumsum([len(ids) for ids in lists]))).astype(np.int64)).to_pylist()


def test_decoding_equals_piece_by_piece(pieces):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randrange(32_000), rng.choice(pieces.byte), rng.choice(pieces.byte[128:])]) for _ in range(rng.randrange(12))] for _ in range(3000)]
    assert decoded(pieces, lists) == [slow(pieces, ids) for ids in lists]
    assert decoded(pieces, [[], [-1, 10**6], []]) == ["", "", ""] and decoded(pieces, []) == []


def test_neighbours_equal_full_merging(pieces):
    rng, ids = random.Random(5), list(pieces.text)
    starts = {}
    for k in ids:
        starts.setdefault(pieces.text[k][0], []).append(k)
    for _ in range(6000):
        left, right = rng.choice(ids), rng.choice(ids)
        if rng.random() < 0.5:  # pieces that overlap a longer one
            cut = rng.randrange(1, max(2, len(pieces.text[left])))
            left, right = (pieces.ids.get(pieces.text[left][:cut], left), pieces.ids.get(pieces.text[left][cut:], right))
        whole = pieces._merged(pieces.text[left] + pieces.text[right])
        assert pieces._apart(left, right) == (whole == [pieces.text[left], pieces.text[right]]), (pieces.text[left], pieces.text[right])


def test_words_that_begin_alike(pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(8)
    stems = ["".join(rng.choice("thanerionsd") for _ in range(max(PREFIXES))) for _ in range(40)]
    words = [s[: rng.randrange(2, 9)] + "".join(rng.choice("thanerionsd.é") for _ in range(rng.randrange(12))) for s in stems for _ in range(30)]
    for word in words:
        assert np.frombuffer(pieces.encode(word), np.int32).tolist() == library.encode(word)
    text = " ".join(words)
    assert np.frombuffer(Pieces(MODEL).encode(text), np.int32).tolist() == library.encode(text)
