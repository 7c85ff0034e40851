"""The prefix trie against rebuilt texts in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pressgrid.llm.prefix_scan import PRIME, running
from pressgrid.llm.prefix_trie import prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    def tie(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0, tie(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20
        path = tuple(own.get(base, [])[:h] + seq[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []

    def below(path):
        leaves = 0 if children[path] else 1
        saved = (len(members[path]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        for child in children[path]:
            a, b = below(child)
            leaves, saved = leaves + a, saved + b
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()))
        return leaves, saved

    if own:
        below(())
    return sorted(out, key=str)


def found(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(f"own {n}") for n in ("depth", "words", "place", "x0", "digest", "__part")})
    return sorted(map(tuple, prefix_nodes(df.repartition(5), **extra).collect()), key=str)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    said = [f"{w} said {k} times" for k in range(4) for w in ("one", "two words")] + ["", " ", None]
    rows = []
    for c in range(1, 140):
        if c % 37 == 0:
            continue
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(said)))
    for c in (7, 20, 41):  # copies
        rows += [(c + 500, t, r, x) for k, t, r, x in rows if k == c]
    rows += [(900, None, "user", "null turn"), (900, None, "user", "null turn"), (900, 1, "user", "x"), (900, 1, "user", "a"), (None, 1, "user", "nobody"), (-5, 0, "user", "below zero")]
    rows += [(1000, t, "user", f"long {t % 5}") for t in range(300)]
    return rows


def test_nodes(spark, talks):
    assert found(spark, talks) == brute(talks)


def test_one_conversation_over_many_partitions(spark):
    rows = [(40, t, "user", f"word {t % 3}") for t in range(3000)] + [(40 + k, t, "user", f"word {t % 3}") for k in range(1, 20) for t in range(9)]
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", saved)
    by = {(r[0], r[1]): r for r in got}
    assert by[40, 0][3:7] == (20, 1, by[40, 0][5], sum(19 * 2 for _ in range(9))) and by[40, 3000][4] == 0
    assert len([r for r in got if r[0] == 40]) == 3001


def test_many_conversations_that_end_at_one_node(spark):
    rows = [(c, 0, "user", "same") for c in range(2500)]
    got = found(spark, rows)
    assert got == brute(rows)


def test_colliding_fingerprints_are_taken_anew(spark, talks):
    assert found(spark, talks, moduli=(5, 7, PRIME)) == brute(talks)
    with pytest.raises(RuntimeError):
        prefix_nodes(spark.createDataFrame(talks, SCHEMA), moduli=(5,))


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    assert found(spark, [(3, None, None, None)]) == brute([(3, None, None, None)])


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randrange(100)) for k in range(2000)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(6)
    got = {(r.key, r.at): (r.place, r.total) for r in running(df, "key", [F.col("at")], {"v": "total"}, "place").collect()}
    powers = {(r.key, r.at): r.total for r in running(df, "key", [F.col("at")], {"v": "total"}, "place", [31], 101).collect()}
    for key in (1, 2, 3):
        total = weighted = 0
        for place, (_, at, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            total, weighted = total + v, (weighted + v * pow(31, place, 101)) % 101
            assert got[key, at] == (place, total) and powers[key, at] == weighted
