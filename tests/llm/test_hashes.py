"""Hashes that tell texts apart, against texts made to collide."""

import random
from collections import Counter

import numpy as np
import pytest

from pressgrid.llm import buffers
from pressgrid.llm.line_dedup import dedup_lines
from pressgrid.llm.ngram_join import ngram_components
from tests_llm_brute import brute_components


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("letters", ["ab", "xy", "aé", "日本"])
def test_thue_morse_words(spark, frame, letters):
    """Sequences on which polynomials modulo a power of two collide for every base."""
    rows = []
    for n in (1024, 2048, 8192):
        one, other = thue_morse(n, letters), thue_morse(n, letters[::-1])
        rows += [one, other, f"start {one} end of it", f"start {other} end of it",
                 " ".join(one[k : k + 7] for k in range(0, n, 7)), " ".join(other[k : k + 7] for k in range(0, n, 7))]
    df = frame(list(enumerate(rows)))
    kept = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert kept == dict(enumerate(rows))
    got = ngram_components(df, width=4, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(list(enumerate(rows)), 4, 85)
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 1)  # a text of one word


def test_ranges_of_one_buffer(monkeypatch):
    """The hash of a range is that of its bytes alone, wherever it lies and however sums are cut."""
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    start = np.array([rng.randrange(4900) for _ in range(600)])
    end = start + np.array([rng.randrange(60) for _ in range(600)])
    for kind in (0, 1):
        whole = buffers.field_hashes(data, start, end, kind)
        alone = [int(buffers.field_hashes(data[a:b], np.array([0]), np.array([b - a]), kind)[0]) for a, b in zip(start, end)]
        assert whole.tolist() == alone
        by_text = {}
        for a, b, h in zip(start, end, whole.tolist()):
            assert by_text.setdefault(text[a:b], h) == h
        assert len(set(by_text.values())) == len(by_text)
        monkeypatch.setattr(buffers, "SUM_BYTES", 7)
        assert buffers.field_hashes(data, start, end, kind).tolist() == alone
        monkeypatch.undo()
