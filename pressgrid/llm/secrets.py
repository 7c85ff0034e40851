"""Secrets in texts: plain findings, and weak parts that count only beside their complements.

Everything is built-in expressions. Patterns give the matched strings and the
text between them, from which the places follow. Weak parts (user names,
key-like runs, addresses) are linked by an interval join within their document:
both sides are cut into bins of places, so a part meets only what lies near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.binding import let
from pressgrid.llm.names import unused
from pressgrid.session import settle

# kind, pattern (leftmost, not overlapping), group whose length counts, least length
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("user", r"(?i)(user_?name|user|login|account|client_?id|key_?id)" + _VALUE, 2, 3),
    ("key", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    ("address", r"""(?i)(?:https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]{4,}""", 0, 8),
]
KINDS = [k for k, *_ in BASE + WEAK]
# what each part is, and what a weak part needs near it
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "key": "secret", "address": "endpoint"}
NEEDS = {"user": ["secret"], "key": ["identifier"], "address": ["identifier", "secret"]}
REACH = 200  # code points between a weak part and its complement
BIN = 512
BLOCK, PART = 256, 1024  # findings that are put in order at once, and code points of a part of a text


def _matches(pattern: str, group: int, least: int) -> tuple[Column, Column]:
    """Matched strings, and whether a match is long enough."""
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: (
        F.length(F.regexp_extract(m, pattern, group)) >= least if group else F.length(m) >= least)


def _in_order(items: Column, at: Column, none: Column, step) -> Column:
    """(at, out) after `step(state, item)` over all items, where each step may add to the array `out`.

    Adding to an array copies it. Items are taken in blocks, so copies grow with the number of
    items times a block, not with its square.
    """
    last = F.ceil(F.size(items) / BLOCK).cast("int") - 1
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(at.alias("at"), F.slice(F.array(none), 1, 0).alias("out"))

    def block(state, some):
        begun = F.struct(state["at"].alias("at"), none.alias("out"))
        return let(F.aggregate(some, begun, step), lambda done: F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    return F.aggregate(blocks, start, block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Findings of one kind from its matches and the text between them."""
    enough = _matches(pattern, group, least)[1]

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        found = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        keep = enough(pair["match"])
        if kind == "key":
            keep = keep & pair["match"].rlike("[a-z]") & pair["match"].rlike("[A-Z]") & pair["match"].rlike("[0-9]")
        out = F.when(keep, F.concat(state["out"], F.array(found))).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.zip_with(F.slice(F.split("text", pattern, -1), 1, F.size(f"_{kind}")), f"_{kind}",
                       lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<start:long,rank:int,end:long>>")
    return F.when(F.size(f"_{kind}") > 0, let(pairs, lambda p: _in_order(p, F.lit(0).cast("long"), none, step)["out"]))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(spans, lambda s: F.struct(kinds[s["rank"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, spans) per row of `docs`: findings in order of place, then kind as in KINDS.

    `base` holds the plain findings, `spans` also the weak ones that were linked:
    a user name with a secret within REACH code points, a key-like run with an
    identifier, an address with both. Places are code points, the end exclusive.
    `text_key` is xxhash64 of the text (null counts as empty). Rows are
    independent, repeated ones and those without a doc_id too.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rules = BASE + WEAK
    matched = text.withColumns({f"_{k}": _matches(p, g, n)[0] for k, p, g, n in rules})
    empty = F.array().cast("array<struct<start:long,rank:int,end:long>>")
    found = matched.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"),
        F.sort_array(F.concat(*[F.coalesce(_spans(*r), empty) for r in BASE])).alias("base"),
        F.concat(*[F.coalesce(_spans(*r), empty) for r in WEAK]).alias("weak"))
    found = settle(found)
    linked = _linked(found.filter(F.size("weak") > 0))
    return found.join(linked, "row", "left").select(
        "doc_id", "text_key", _named(F.col("base")).alias("base"),
        _named(F.sort_array(F.concat("base", F.coalesce("linked", empty)))).alias("spans"))


def _linked(found: DataFrame) -> DataFrame:
    """(row, linked): weak parts with all their complements within reach. No pairs are made: the join only asks."""
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    needs = F.array(*[F.array(*[F.lit(n) for n in NEEDS.get(k, [])]).cast("array<string>") for k in KINDS])
    parts = found.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")

    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))).alias("bin")

    near = parts.select("row", roles[F.col("rank")].alias("role"), "start", "end", bins(F.col("start"), F.col("end")))
    weak = parts.filter(F.size(needs[F.col("rank")]) > 0).select("row", "start", "rank", "end", F.explode(needs[F.col("rank")]).alias("need"))
    weak = weak.select("*", bins(F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH))
    a, b = weak.alias("a"), near.alias("b")
    met = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.need") == F.col("b.role"))
                 & (F.col("b.start") <= F.col("a.end") + REACH) & (F.col("b.end") >= F.col("a.start") - REACH), "left_semi")
    return (
        met.groupBy("row", "start", "rank", "end").agg(F.count_distinct("need").alias("n"))
        .filter(F.col("n") == F.size(needs[F.col("rank")]))
        .groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))
    )


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _piece(parts: Column, start: Column, end: Column) -> Column:
    """Code points `start` to `end` of a text given as parts of PART code points; a place is found without reading what lies before."""
    first, last = F.floor(start / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    from_first, to_last = (start % PART).cast("int") + 1, ((end - 1) % PART).cast("int") + 1
    inner = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(start >= end, "").when(first == last, F.substr(F.get(parts, first), from_first, (end - start).cast("int"))).otherwise(
        F.concat(F.substr(F.get(parts, first), from_first), inner, F.substr(F.get(parts, last), F.lit(1), to_last)))


def _without(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; overlapping spans count once, as the first."""
    def cut(parts: Column) -> Column:
        def step(state, s):
            fresh = s["start"] >= state["at"]
            more = F.array(_piece(parts, state["at"], s["start"]), F.concat(F.lit("["), s["kind"], F.lit("]")))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

        done = _in_order(spans, F.lit(0).cast("long"), F.array().cast("array<string>"), step)
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), _piece(parts, d["at"], F.greatest(F.length(text).cast("long"), d["at"]))))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), cut)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with every finding in `text` replaced by its kind in brackets; overlapping findings by the first.

    All columns and rows stay; a text without findings, null included, stays as it is.
    """
    doc, text_key, found, key = unused(docs, "_doc", "_text_key", "_spans", "_key")
    spans = find_secrets(docs.select("doc_id", "text")).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(text_key), F.col("spans").alias(found))
    hashed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = hashed.join(spans, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_key)), "left")
    return joined.withColumn("text", F.when(F.col(found).isNotNull(), _without(F.col("text"), F.col(found))).otherwise(F.col("text"))).select(
        *(F.col(f"`{c}`") for c in docs.columns))
