"""Operators on vectors against brute force."""

import numpy as np
import pytest

from pressgrid.llm import forest, hilbert
from pressgrid.llm.forest import near_vectors
from pressgrid.llm.hilbert import hilbert_keys, nearest_vectors

SCHEMA = "vec_id long, embedding array<double>, cell string, key string, label int, at string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "own", "own", 0, "own") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    out = [(k, rng.normal(size=16).tolist()) for k in range(400)]
    out += [(1000 + k, (centre + 0.08 * rng.normal(size=16)).tolist()) for k in range(150)]
    out += [(2000 + k, out[7][1]) for k in range(40)] + [(2000, out[7][1])]
    out += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [float("nan")] * 16),
            (3005, [float("inf")] * 16), (None, out[7][1]), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e200] + [0.0] * 15), (3009, [3e200] + [1e199] * 15)]
    return out


def usable(rows):
    return [(i, np.array(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]


def brute_links(rows):
    good = usable(rows)
    links = {i: 0 for i, _ in rows if i is not None}
    root = dict(zip(links, links, strict=True))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    per_row = {}
    for k, (i, x) in enumerate(good):
        for m, (j, y) in enumerate(good):
            if k != m and len(x) == len(y):
                u, v = x / np.abs(x).max(), y / np.abs(y).max()
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                    per_row[k] = per_row.get(k, 0) + 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    want = [(i, per_row.get(k, 0), find(i), find(i) == i) for k, (i, _) in enumerate(good)]
    want += [(i, 0, i, i is not None) for i, v in rows if not usable([(i, v)])]
    return sorted(want, key=str)


@pytest.mark.parametrize("leaf,block", [(1024, 2048), (120, 50)])
def test_near_vectors(spark, rows, monkeypatch, leaf, block):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "BLOCK", block)
    got = near_vectors(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)
    assert near_vectors(table(spark, [])).count() == 0


def test_curve_is_a_curve():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert set(np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def brute_nearest(rows, every, k):
    good = [(i, v) for i, v in usable(rows) if len(v) == 16]
    good = sorted({i: v for i, v in reversed(good)}.items())
    out = {}
    for i, x in good:
        if i % every == 0:
            scored = sorted((-float(np.sum(x * y)), j) for j, y in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_nearest_vectors(spark, rows, monkeypatch):
    small = [r for r in rows if r[0] not in (3008, 3009)]
    want = brute_nearest(small, 20, 20)
    monkeypatch.setattr(hilbert, "BLOCK", (64, 64))
    got = {}
    for r in sorted(nearest_vectors(table(spark, small)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(near) == len(want[q])
        known = dict(brute_nearest([r for r in small if r[0] in {q, *(j for j, _ in near)}], 20, 50)[q])
        assert all(abs(known[j] - s) < 1e-9 for j, s in near)


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (3, [2.0, -5.0]), (3, [2.0, -5.0]), (5, [2.0, 0.5])]
    got = nearest_vectors(table(spark, rows)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 2.0), (0, 2, 3, 2.0), (0, 3, 5, 2.0)]
    assert nearest_vectors(table(spark, [])).count() == 0
    assert nearest_vectors(table(spark, [(0, [1.0]), (20, None)])).count() == 0


def test_each_length_has_its_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(61)] + [(100 + k, rng.normal(size=3).tolist()) for k in range(41)] + [(200, [1.0])]
    got = {}
    for r in sorted(nearest_vectors(table(spark, rows), k=5, recall=1.0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in rows if len(w) == len(v) and i != q)[:5]
            want |= {q: [i for _, i in near]} if near else {}
    assert got == want and {0, 60, 100, 140} <= set(got)
