"""Structure repair against a search over all edit lists, and its parts."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pressgrid.llm.queries import damaged
from pressgrid.llm.structure_repair import COMPACT_NODES, Search, Trails, audit_conversations, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """All edit lists with at most one inserted pair at a place, tried one by one: turns are (initial, deleted, truncated)."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    choices = [[("D", None)] if deleted else [("D", None), ("K", i), ("R", "u"), ("R", "a")] for i, deleted, _ in turns]
    for row_edits in itertools.product(*choices):
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (t[2] and e != "D") for (e, _), t in zip(row_edits, turns, strict=True))
        for put in itertools.product(inserts, repeat=len(turns) + 1):
            cost = base + 2 * sum(map(len, put))
            if best is not None and cost > best[0]:
                continue
            roles = audit = ""
            for k, more in enumerate(put):
                roles, audit = roles + more, audit + "I" * len(more)
                if k < len(turns):
                    roles, audit = roles + (row_edits[k][1] or ""), audit + row_edits[k][0]
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_search_is_exact():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(40):
            turns = [(rng.choice("suauax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            search = Search()
            for t in turns:
                search.turn(*t)
            assert search.result() == cheapest(turns), turns


def plain(turns):
    """The same search with whole strings."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def closed(best):
        for to, sources in ((2, (0, 1, 3)), (3, (2,))):
            best[to] = min([best[to]] + [(best[s][0] + 2, best[s][1] + "I") for s in sources])
        return best

    best = closed([(0, ""), *[(10**9, "")] * 3])
    for initial, deleted, truncated in turns:
        now = [[(10**9, "")] for _ in range(4)]
        for s, (cost, audit) in enumerate(best):
            now[s].append((cost + 3, audit + "D"))
            if not deleted:
                if (s, initial) in step:
                    now[step[s, initial]].append((cost + truncated, audit + "K"))
                now[3 if s == 2 else 2].append((cost + 2 + truncated, audit + "R"))
        best = closed([min(n) for n in now])
    return min(best[0], best[3])


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 3])
def test_long_conversations(modulus):
    rng = random.Random(6)
    seen = 0
    for roles in ("suaua", "x", "ua", "uuaas", "ax"):
        for n in (50, 400):
            turns = [(rng.choice(roles), rng.random() < 0.1, rng.random() < 0.3) for _ in range(n)]
            search = Search(modulus)
            for t in turns:
                search.turn(*t)
            assert search.result() == plain(turns)
            seen += search.trails.collisions
    assert (seen > 0) == (modulus == 3)


def test_edits_are_committed_while_they_stream():
    turns = [("suaxua"[k % 6], k % 11 == 0, k % 7 == 0) for k in range(60_000)]
    search = Search()
    for t in turns:
        search.turn(*t)
    assert len(search.trails.edit) < 2 * COMPACT_NODES and search.trails.committed
    cost, audit = search.result()
    assert len(audit.replace("I", "")) == len(turns)
    never = Search()  # two lists that never meet
    for _ in range(40_000):
        never.turn("x", False, False)
    assert never.result() == (80_000, "R" * 40_000)


def test_order_of_lists():
    trails, rng = Trails(), random.Random(7)
    nodes = {"": 0}
    for _ in range(300):
        base = rng.choice(list(nodes))
        edit = rng.choice("DIKR")
        if base + edit not in nodes:
            nodes[base + edit] = trails.add(nodes[base], edit)
    for a, b in itertools.product(rng.sample(sorted(nodes), 60), repeat=2):
        assert trails.less(nodes[a], nodes[b]) == (a < b)


def brute(rows):
    def sha(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    out, texts = {}, {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, sha(" " if r is None else r, " " if x is None else x), " " if r is None else r, " " if x is None else x)
                        for c, t, r, x in rows if c == conv))
        faults, marked, earlier = [0, 0, 0], [], set()
        for _, _, _, role, text in turns:
            bare = text.strip(SPACES)
            fault = 0 if not bare else 1 if (role, text) in earlier else 2 if bare[-1] not in ".!?" else None
            earlier.add((role, text))
            if fault is not None:
                faults[fault] += 1
            marked.append((role[:1], fault in (0, 1), fault == 2))
        numbers = [t[1] for t in turns if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit = plain(marked)
        out[conv] = (gaps, *faults, illegal, cost, audit)
        built, k = [], 0
        for edit in audit:
            if edit in "IR":
                role = "assistant" if built and built[-1][0][:1] == "u" else "user"
                built.append((role, "" if edit == "I" else turns[k][4]))
            elif edit == "K":
                built.append(turns[k][3:])
            k += edit != "I"
        texts[conv] = built
    return out, texts


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    said = ["Yes.", "Why?", "no end", " \t", "", None, "Done!\n ", "a\x00b.", "日本。", "x" * 100_000 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(said))
            for c in [None, *range(150)] for _ in range(rng.randrange(1, 12))]
    return rows + [(200, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(500)] + [(201, 3, "user", "same.")] * 4


def test_tables(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA).withColumns({n: F.lit(f"own {n}") for n in ("kind", "digest", "audit", "initial", "blank")}).repartition(6)
    audits = audit_conversations(df)
    want, texts = brute(talks)
    assert {r.conv_id: tuple(r)[1:] for r in audits.collect()} == want
    built = {}
    for r in repair_conversations(df, audits).orderBy("conv_id", "place").collect():
        built.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert built == {c: [(k, *t) for k, t in enumerate(v, 1)] for c, v in texts.items() if v}
    none = df.limit(0)
    assert audit_conversations(none).count() == 0 and repair_conversations(none, audit_conversations(none)).count() == 0


def test_damage(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in (None, 1, 2, 3) for t in [None, *range(60)] for r in ("assistant", None)]
    import zlib
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "turn", "role", "text").collect()), key=str)
    want = []
    for c, t, r, x in rows:
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r = " " if r is None else r
        row = (c, t, "user" if act == 4 else r, "" if act == 1 else re.sub("[.!?]", "", x) if act == 2 else x)
        want += [row] * (0 if act == 0 else 2 if act == 3 else 1)
    assert got == sorted(want, key=str)
