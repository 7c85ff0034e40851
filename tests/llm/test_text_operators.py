"""Operators on documents against plain Python over awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pressgrid.llm import line_dedup, ngram_join, packing
from pressgrid.llm.line_dedup import PerfectHash, dedup_lines
from pressgrid.llm.ngram_join import ngram_components
from pressgrid.llm.packing import pack_documents
from pressgrid.llm.pieces import Pieces, decode_pieces, encode_pieces, same_text
from pressgrid.llm.secrets import find_secrets, listed, redact_secrets
from pressgrid.llm.sharding import shard_rows
from tests_llm_brute import brute_components, brute_pieces, lower

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = public_tokenizers.path("piece_bpe_32k.model")
@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_ngram_components(frame, awkward, width, percent):
    got = ngram_components(frame(awkward), width, percent)
    assert Counter(map(tuple, got.collect())) == brute_components(awkward, width, percent)


def test_ngram_components_in_small_blocks(frame, monkeypatch):
    """The same links when n-grams count as widespread early and clusters are cut into many blocks."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(4, 60))] for _ in range(6)]
    rows = []
    for k in range(150):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text + ["the", "common", "passage", "of", "them", "all"] * (k % 2))))
    for name, value in (("HOT_COUNT", 8), ("LOCAL_LEAST", 1), ("TILE_TOKENS", 300), ("BUCKET_TOKENS", 500), ("ROW_BLOCK", 7), ("COLUMN_BLOCK", 11), ("DENSE_FROM", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    for percent in (60, 80):
        got = ngram_components(frame(rows), 3, percent)
        assert Counter(map(tuple, got.collect())) == brute_components(rows, 3, percent)


def test_line_dedup(frame, awkward):
    holders = {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for d, t in awkward:
        for line in (t or "").split("\n") if d is not None else ():
            holders.setdefault(key(line), set()).add(d)
    want = Counter()
    for d, t in awkward:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        want[d, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = dedup_lines(frame(awkward))
    assert "own token" in {r["token"] for r in got.collect()}
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == want


def test_hot_line_is_probed_by_several_tasks(frame, monkeypatch):
    """A line of all documents, several times in each, is folded and dealt out; the rows stay the same."""
    rows = [(k, f"own line number {k}\n" + "the line of all documents\n" * 5) for k in range(3_000)]
    monkeypatch.setattr(line_dedup, "PROBE_LINES", 500)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 10_000)
    docs = frame(rows).select("doc_id", "text")
    packets, index = line_dedup.probe_packets(docs, line_dedup.line_index(docs))
    sizes = {(r["shard"], r["salt"]): r["n"] for r in packets.groupBy("shard", "salt").agg(F.sum(F.octet_length("key") / 8).alias("n")).collect()}
    assert sum(sizes.values()) == 6_000 and max(sizes.values()) < 700
    assert set(sizes) == {(r["shard"], r["salt"]) for r in index.collect()}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).collect()}
    assert got == {d: (t if d == 0 else f"own line number {d}\n", 7, 5 * (d > 0)) for d, t in rows}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    slots = PerfectHash(keys)
    assert sorted(slots.index(keys)) == list(range(len(keys)))


def test_secrets(frame, awkward):
    def base(text):
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
            r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))

    got = find_secrets(frame(awkward)).select("doc_id", listed(F.col("base")).alias("base"), listed(F.col("spans")).alias("spans")).collect()
    assert Counter((r["doc_id"], r["base"]) for r in got) == Counter((d, base(t or "")) for d, t in awkward)
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[19] == "user:0:10,key:11:53,address:57:82,assign:83:100"  # the parts complete one another
    assert spans[20] == ""  # an address and a key-like run without an identifier
    text = {r["doc_id"]: r["text"] for r in redact_secrets(frame(awkward)).collect()}
    assert text[19] == "[user] [key] at [address] [assign]"
    assert text[1] is None and text[2] == "" and text[9] == dict(awkward)[9]
    assert text[18].endswith("[access] [hex]")


def test_packing(frame, awkward, monkeypatch):
    monkeypatch.setattr(packing, "RUN_TOKENS", 5_000)
    pieces = pack_documents(frame(awkward), RANKS, PATTERN).collect()
    documents = Counter()
    open_ = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], np.uint32).tobytes())
        own = open_.setdefault(p["doc_id"], [])
        assert p["start"] == len(own)
        own += p["ids"]
        if len(own) == p["doc_tokens"]:
            documents[p["doc_id"], tuple(open_.pop(p["doc_id"]))] += 1
    assert not open_
    assert documents == Counter((d, tuple(ids)) for d, ids in brute_pieces(awkward))
    sizes = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sizes[p["sequence_id"]]
        sizes[p["sequence_id"]] += p["length"]
    assert max(sizes.values()) <= 1024
    padding = sum(1024 - s for s in sizes.values() if s & (s - 1))
    assert padding < 0.03 * sum(sizes.values())


def test_packing_keeps_the_tokenizers_ids(frame):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 1_500), (3, "a" + " " * 1_200_000 + "b"), (4, "\n" * 1_200_000), (5, "<|endoftext|"),
            (6, "a <|endoftext|>\n\xa0" + "\u3000" * 1_100_000)]
    got = {}
    for p in sorted(pack_documents(frame(rows), RANKS, PATTERN).collect(), key=lambda p: (p["doc_id"], p["start"])):
        got.setdefault(p["doc_id"], []).extend(p["ids"])
    assert got == dict(brute_pieces(rows))


def test_cuts_are_the_best():
    rng = random.Random(1)
    for powers in (False, True):
        for _ in range(40):
            place = sorted(rng.sample(range(1, 60), rng.randrange(8, 30)))
            place = [0, *[p for p, q in zip(place, [0, *place], strict=False) if p - q <= 16]]
            place = [p for k, p in enumerate(place) if all(b - a <= 16 for a, b in zip(place[: k + 1], place[1 : k + 1], strict=False))]
            penalty = [rng.randrange(6) for _ in place]

            def cost(size):
                return packing.SHORT_COST if powers and size < 16 and size & (size - 1) == 0 and packing.SHORT_COST < 16 - size else 16 - size

            best = [0] + [None] * (len(place) - 1)
            for k in range(1, len(place)):
                best[k] = penalty[k] + min(best[j] + cost(place[k] - place[j]) for j in range(k) if place[k] - place[j] <= 16)
            cuts = packing.best_cuts(place, penalty, 16, powers)
            at = [0, *(place.index(c) for c in cuts)]
            assert best[-1] == sum(penalty[b] + cost(place[b] - place[a]) for a, b in zip(at, at[1:], strict=False))


def test_pieces_are_the_models_own(frame, awkward):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*awkward, (30, "▁ mark  and   runs "), (31, "ab" * 5000), (32, "�①🙂")]
    got = decode_pieces(encode_pieces(frame(rows), MODEL), MODEL).withColumn("same", same_text()).collect()
    assert all(r["same"] for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(model.encode(t or ""))) for d, t in rows)


def test_long_runs_of_marks():
    import sentencepiece
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(MODEL)
    for marks in ("\n" * 10_000, ";!" * 5_000, '.,;:!?"()\n' * 1_000, "!" * 10_000):
        for text in (marks, "word" + marks, marks + "word", f"word{marks} word{marks}"):
            assert np.frombuffer(pieces.encode(text), np.int32).tolist() == model.encode(text)


def test_stream_commits_early():
    pieces = Pieces(MODEL)
    taken = 0

    def characters():
        nonlocal taken
        for c in "▁" + "abcdefgh" * 500:
            taken += 1
            yield c

    stream = pieces.stream(characters())
    next(stream)
    assert taken <= 4 * pieces.longest


def test_shards(frame, awkward):
    rows = [*awkward, *[(500, f"{k} " * 40) for k in range(50)], *[(None, "same row")] * 9]
    for limit in (200, 2_000, 50_000, 10_000_000):
        got = shard_rows(frame(rows), limit).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        size, n = Counter(), Counter()
        for r in got:
            assert r["row_bytes"] == len((r["text"] or "").encode())
            assert len(r["shard"].replace(".", "")) == r["depth"]
            size[r["shard"]] += r["row_bytes"]
            n[r["shard"]] += 1
        assert all(size[s] <= limit or n[s] == 1 for s in size)
        homes = sorted(size)
        assert not any(b.startswith(a) for a, b in zip(homes, homes[1:], strict=False))  # no shard within another
        for s in homes:  # only what was too large was split: the shard above did not fit
            above = [r for r in got if r["shard"].startswith(s[:-1])]
            assert not s or s.endswith(".") or sum(r["row_bytes"] for r in above) > limit


def test_empty_tables(spark, frame):
    none = frame([])
    assert ngram_components(none).count() == 0
    assert dedup_lines(none).count() == 0
    assert find_secrets(none).count() == 0
    assert redact_secrets(none).count() == 0
    assert pack_documents(none, RANKS, PATTERN).count() == 0
    assert encode_pieces(none, MODEL).count() == 0
    assert shard_rows(none, 100).count() == 0


def test_hash_of_lines_is_of_whole_text(frame):
    long = "\n".join(f"line number {k} of a long text" for k in range(20_000))
    got = dedup_lines(frame([(1, long), (2, long + "\nthe last line differs")])).orderBy("doc_id").collect()
    assert got[0]["text"] == long and got[1]["text"] == "the last line differs"
    assert hashlib.sha256(got[0]["text"].encode()).hexdigest()
