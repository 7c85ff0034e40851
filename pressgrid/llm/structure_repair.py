"""Repair of a conversation's turn structure by the cheapest list of edits.

A repaired conversation's roles read `(s?(ua)+)?` by their initials. A search over turns keeps for each
state of that pattern the cheapest edits so far, the least in ASCII order among equals.
Edit lists are persistent: a list is a node that points to the list without its last edit, with
ancestors at all powers of two and a rolling hash, so two lists are compared by searching for
the end of their common beginning. Turns stream through the search in order; only edits are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.session import settle

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what was put out last
LEGAL = frozenset({"su", "ua", "au"})
COMPACT_NODES = 1 << 16
MODULUS, BASE = (1 << 61) - 1, 0x1F3D5B79A
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}


class Trails:
    """Persistent edit lists. Equal lists made in one step are one node, so equal lists are always one node."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.committed: list[str] = []
        self.limit = COMPACT_NODES
        self.collisions = 0
        self._clear()

    def _clear(self) -> None:
        self.edit, self.up, self.depth, self.hash = [""], [()], [0], [0]  # node 0: the empty list, or all that is committed
        self.fresh: dict[tuple[int, str], int] = {}

    def next_turn(self) -> None:
        self.fresh.clear()

    def add(self, node: int, edit: str) -> int:
        """The list `node` with one more edit."""
        known = self.fresh.get((node, edit))
        if known is None:
            ups, at, k = [node], node, 0
            while k < len(self.up[at]):
                at = self.up[at][k]
                ups.append(at)
                k += 1
            known = self.fresh[node, edit] = len(self.edit)
            self.edit.append(edit)
            self.up.append(tuple(ups))
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * BASE + ord(edit)) % self.modulus)
        return known

    def _lifted(self, node: int, depth: int) -> int:
        drop, k = self.depth[node] - depth, 0
        while drop:
            if drop & 1:
                node = self.up[node][k]
            drop >>= 1
            k += 1
        return node

    def _fork(self, a: int, b: int, of) -> tuple[int, int]:
        """Ancestors of two nodes of one depth right behind their longest common beginning, equal where `of` is."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]):
                x, y = self.up[a][k], self.up[b][k]
                if of(x) != of(y):
                    a, b = x, y
        return a, b

    def less(self, a: int, b: int) -> bool:
        """Whether list `a` comes before list `b`."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lifted(a, depth), self._lifted(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        end_a, end_b = self._fork(x, y, self.hash.__getitem__)
        if self.hash[x] == self.hash[y] or self.up[end_a][0] != self.up[end_b][0]:
            self.collisions += 1  # the same hash for different lists: search by the nodes themselves
            end_a, end_b = self._fork(x, y, int)
        return self.edit[end_a] < self.edit[end_b]

    def path(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def compact(self, live: list[int]) -> list[int]:
        """Drops nodes that no live list needs and commits what all live lists begin with; returns the live nodes' new numbers."""
        paths = [self.path(n) for n in live]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        self.committed += [self.edit[n] for n in paths[0][:shared]]
        old = self.edit
        self._clear()
        number: dict[int, int] = {}
        out = []
        for p in paths:
            at = 0
            for n in p[shared:]:
                if n not in number:
                    number[n] = self.add(at, old[n])
                at = number[n]
            out.append(at)
        self.limit = max(COMPACT_NODES, 2 * len(self.edit))
        return out

    def text(self, node: int) -> str:
        return "".join(self.committed) + "".join(self.edit[n] for n in self.path(node))


class Search:
    """The cheapest edits of one conversation, turn by turn."""

    def __init__(self, modulus: int = MODULUS):
        self.trails = Trails(modulus)
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # (cost, edits) per state
        self._insert()

    def _offer(self, best, state: int, cost: int, node: int, edit: str) -> None:
        old = best[state]
        if old is None or cost < old[0]:
            best[state] = (cost, self.trails.add(node, edit))
        elif cost == old[0]:
            new = self.trails.add(node, edit)
            if self.trails.less(new, old[1]):
                best[state] = (cost, new)

    def _insert(self) -> None:
        """Turns put in here; more than one of each role only costs."""
        best = self.best
        for state in (START, SYSTEM, ASSISTANT):
            if best[state]:
                self._offer(best, USER, best[state][0] + INSERT_COST, best[state][1], INSERT)
        if best[USER]:
            self._offer(best, ASSISTANT, best[USER][0] + INSERT_COST, best[USER][1], INSERT)
        # What follows on the states before the first user turn can follow on ASSISTANT too, once a system turn is deleted.
        for state, more in ((START, DELETE_COST), (SYSTEM, 0)):
            if best[state] and best[ASSISTANT] and best[state][0] > best[ASSISTANT][0] + more:
                best[state] = None

    def turn(self, initial: str, deleted: bool, truncated: bool) -> None:
        before, now, extra = self.best, [None] * 4, TRUNCATED_COST * truncated
        self.trails.next_turn()
        for state, found in enumerate(before):
            if found:
                cost, node = found
                self._offer(now, state, cost + DELETE_COST, node, DELETE)
                if not deleted:
                    if (state, initial) in _STEP:
                        self._offer(now, _STEP[state, initial], cost + extra, node, KEEP)
                    self._offer(now, ASSISTANT if state == USER else USER, cost + REROLE_COST + extra, node, REROLE)
        self.best = now
        self._insert()
        if len(self.trails.edit) > self.trails.limit:
            live = [s for s in range(4) if self.best[s]]
            for s, node in zip(live, self.trails.compact([self.best[s][1] for s in live]), strict=True):
                self.best[s] = (self.best[s][0], node)

    def result(self) -> tuple[int, str]:
        """(cost, edits)."""
        found = [b for b in (self.best[START], self.best[ASSISTANT]) if b]
        cost, node = found[0]
        for more, other in found[1:]:
            if more < cost or (more == cost and self.trails.less(other, node)):
                cost, node = more, other
        return cost, self.trails.text(node)


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length(role), F.concat(role, text)), 256))


def _filled(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))


_ORDER = ["conv_id", "turn", "digest", "kind"]  # nulls first, and a marker (kind 0) before the turn it marks


def audit_conversations(conversations: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation.

    Turns go by `turn`, null first; turns of one number go by the SHA-256 of role
    and text. Null roles and texts count as one space, a null conv_id is a
    conversation of its own, other columns are not read, an empty table gives no rows. The first fault of a
    turn counts: blank, duplicate (role and text seen earlier), truncated. Texts stay
    where they are: the search sees roles, faults and order only. A conversation streams through one task
    because each choice rests on the one before; its memory holds the edits, not its turns.
    """
    rows = _filled(conversations)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select(
        "conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), F.lit(1).alias("kind"))
    # Where a role and text first occur: one marker each, so no join on text or conversation is needed.
    first = marked.groupBy("conv_id", "digest").agg(F.max(F.col("turn").isNull()).alias("early"), F.min("turn").alias("turn")).select(
        "conv_id", F.when(~F.col("early"), F.col("turn")).alias("turn"), "digest", F.lit("").alias("initial"), F.lit(False).alias("blank"),
        F.lit(False).alias("truncated"), F.lit(0).alias("kind"))
    columns = ["conv_id", "turn", "digest", "initial", "blank", "truncated", "kind"]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False

        def start(conv):
            return {"conv": conv, "search": Search(modulus), "faults": [0, 0, 0], "illegal": 0, "last": None, "turns": [None, None, 0], "marker": None}

        def finish(found):
            cost, audit = found["search"].result()
            low, high, n = found["turns"]
            gaps = 0 if low is None else high - low + 1 - n
            return (found["conv"], gaps, *found["faults"], found["illegal"], cost, audit)

        def out(done):
            return pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.column("conv_id").type, *[pa.int64()] * 6, pa.string()]
            done = []
            for conv, turn, digest, initial, blank, truncated, is_turn in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if not open_ or conv != now["conv"]:
                    if open_:
                        done.append(finish(now))
                    now, open_ = start(conv), True
                if not is_turn:
                    now["marker"] = (turn, digest)
                    continue
                duplicate = now["marker"] != (turn, digest)
                now["marker"] = None  # a second one like it is a duplicate
                fault = 0 if blank else 1 if duplicate else 2 if truncated else None
                if fault is not None:
                    now["faults"][fault] += 1
                if now["last"] is not None and now["last"] + initial not in LEGAL:
                    now["illegal"] += 1
                now["last"] = initial
                if turn is not None:
                    low, high, n = now["turns"]
                    now["turns"] = [turn if low is None else low, turn, n + (turn != high)]
                now["search"].turn(initial, fault in (0, 1), fault == 2)
            yield out(done)
        if open_:
            yield out([finish(now)])

    stream = marked.select(*columns).unionByName(first).repartition("conv_id").sortWithinPartitions(*_ORDER)
    return settle(stream.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))


def repair_conversations(conversations: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place from 1, role, text) that `audits` makes of `conversations`, in order within each partition.

    A conversation's edits come before its turns in one sorted stream, so no conversation is gathered.
    """
    rows = _filled(conversations).withColumn("kind", F.lit(1))
    types = dict(rows.dtypes)
    plans = audits.select("conv_id", F.lit(None).cast(types["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                          F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits, at, place, last = None, "", 0, 0, ""
        for batch in batches:
            out = []

            def put(role, text):
                nonlocal place, last
                place, last = place + 1, role[:1]
                out.append((conv, place, role, text))

            def insert():
                nonlocal at
                while edits[at : at + 1] == INSERT:
                    put("assistant" if last == "u" else "user", "")
                    at += 1

            for c, role, text, is_turn in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "kind")), strict=True):
                if not is_turn:
                    conv, edits, at, place, last = c, text, 0, 0, ""
                    insert()
                    continue
                edit, at = edits[at], at + 1
                if edit == KEEP:
                    put(role, text)
                elif edit == REROLE:
                    put("assistant" if last == "u" else "user", text)
                insert()
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array(v, t) for v, t in zip(cols, (batch.column("conv_id").type, pa.int64(), pa.string(), pa.string()), strict=True)],
                                  ["conv_id", "place", "role", "text"])

    stream = rows.unionByName(plans).repartition("conv_id").sortWithinPartitions(*_ORDER)
    return stream.mapInArrow(run, f"conv_id {types['conv_id']}, place long, role string, text string")
