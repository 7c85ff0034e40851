"""Which dictionary names occur in which texts.

A name matches where it stands between two characters that are not a-z or 0-9
(text lower-cased and padded with blanks). Instead of testing every name on
every text, each name is filed under its longest run of a-z0-9: such a run is a
whole token of any text the name matches, so only names filed under a token of
the text need the exact test. Names without such a run (of other scripts, say)
are filed under one of their characters. Nothing is lost either way.

Small dictionaries (measured) travel as one indexed constant and the test runs
in the scan: no shuffle, and article bodies never move. Larger ones are joined
on the token, under the run that fewest names share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.binding import let
from pressgrid.operators.lookup import is_small, lookup, salted_join
from pressgrid.session import settle

INLINE_ROWS = 2_000
INLINE_BYTES = 1 << 20
_SEPARATOR = "[^a-z0-9]+"


def entries(dictionary: DataFrame, name: str, kind: str = "", **attrs: str) -> DataFrame:
    """(kind, name, attrs) rows of one dictionary; blank names are left out."""
    picked = [F.col(c).cast("string").alias(a) for a, c in attrs.items()]
    return dictionary.filter(F.trim(name) != "").select(
        F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), *picked)


def _filed(dictionary: DataFrame) -> DataFrame:
    needle = F.lower("name")
    longest = F.aggregate(
        F.split(needle, _SEPARATOR), F.lit(""),
        lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    quoted = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    quoted = F.concat(F.lit("\\Q"), quoted, F.lit("\\E"))
    # the name first, then a look at both neighbours: the matcher skips ahead on the literal
    pattern = F.concat(quoted, F.lit("(?<![a-z0-9]"), quoted, F.lit(")(?![a-z0-9])"))
    token = F.when(longest != "", longest).otherwise(F.substr(F.trim(needle), F.lit(1), F.lit(1)))
    return dictionary.select(
        token.alias("token"),
        F.struct(needle.alias("needle"), pattern.alias("pattern"), F.struct(*dictionary.columns).alias("entry")
                 ).alias("candidate"))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def _tokens(padded: Column, odd: bool) -> Column:
    """The distinct runs of a text, and with `odd` its other characters as well."""
    runs = F.split(padded, _SEPARATOR)
    if odd:
        runs = F.concat(runs, F.split(F.regexp_replace(padded, "[a-z0-9 ]+", ""), ""))
    return F.array_distinct(runs)


def _stands_in(padded: Column, candidate: Column) -> Column:
    return padded.contains(candidate["needle"]) & F.rlike(padded, candidate["pattern"])


def _by_token(dictionary: DataFrame) -> DataFrame:
    return _filed(dictionary).groupBy("token").agg(F.collect_list("candidate").alias("candidates"))


def _inline(df: DataFrame, dictionary: DataFrame, texts: dict[str, Column]) -> DataFrame:
    indexed = _by_token(dictionary).agg(F.map_from_entries(F.collect_list(F.struct("token", "candidates"))).alias("m"))
    # a constant is shared by all rows; a column or subquery would be copied into each of them
    as_json = indexed.select(F.to_json("m")).first()[0]
    odd = not dictionary.filter(~F.lower("name").rlike("[a-z0-9]")).isEmpty()
    index = F.from_json(F.lit(as_json), indexed.schema["m"].dataType.simpleString())

    def matches(padded: Column) -> Column:
        tokens = F.array_intersect(_tokens(padded, odd), F.map_keys(index))
        found = F.flatten(F.transform(tokens, lambda t: F.element_at(index, t)))
        return F.transform(F.filter(found, lambda c: _stands_in(padded, c)), lambda c: c["entry"])

    return df.withColumns({out: let(_padded(text), matches) for out, text in texts.items()})


def _filed_by_rarest(dictionary: DataFrame) -> DataFrame:
    """As `_filed`, but under the run (or character) that fewest names share: common words do not gather all names."""
    runs = F.filter(F.array_distinct(F.split(F.col("candidate.needle"), _SEPARATOR)), lambda r: r != "")
    characters = F.filter(F.array_distinct(F.split(F.col("candidate.needle"), "")), lambda c: F.trim(c) != "")
    runs = F.when(F.size(runs) > 0, runs).otherwise(characters)
    each = _filed(dictionary).select("candidate", F.explode_outer(runs).alias("run"))
    shared = each.filter("run IS NOT NULL").groupBy("run").agg(F.count("*").alias("n"))
    return (
        each.join(shared, "run", "left").groupBy("candidate")
        .agg(F.coalesce(F.min_by("run", F.struct("n", "run")), F.lit("")).alias("token"))
    )


def _joined(df: DataFrame, dictionary: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Matches are found per text, known by its digest, so rows that share a key but not a text never mix."""
    marked = df.withColumns({f"_h_{out}": F.md5(_padded(text)) for out, text in texts.items()})
    odd = not dictionary.filter(~F.lower("name").rlike("[a-z0-9]")).isEmpty()
    filed = settle(_filed_by_rarest(dictionary))
    narrow = reduce(DataFrame.unionByName, [
        df.filter(text.isNotNull()).select(F.md5(_padded(text)).alias("_h"), _padded(text).alias("_padded")) for text in texts.values()])
    tokens = narrow.withColumn("token", F.explode(_tokens(F.col("_padded"), odd)))
    if is_small(filed):  # the text is only referred to while the tokens stream past the broadcast names
        pairs = tokens.join(F.broadcast(filed), "token")
    else:  # tokens travel without the text; it is fetched again for the candidates
        met = salted_join(tokens.select("_h", "token"), filed, "token", "inner", spread=["_h"]).select(F.col("_h").alias("_c"), "candidate")
        pairs = narrow.join(met.distinct(), F.col("_h") == F.col("_c"))
    found = settle(
        pairs.filter(_stands_in(F.col("_padded"), F.col("candidate")))
        .groupBy("_h").agg(F.collect_set("candidate.entry").alias("_found")))  # at most the dictionary per text
    for out in texts:
        # texts without a name, most of them, have no row here; small results leave the bodies in place
        marked = lookup(marked, found.toDF(f"_h_{out}", out), f"_h_{out}", spread=[c for c in ("id", "url") if c in df.columns] or None)
    return marked.select(*df.columns, *texts)


def match_names(
    df: DataFrame, dictionary: DataFrame, texts: dict[str, Column], how: str = "auto",
) -> DataFrame:
    """Adds, per entry of `texts`, an array of the dictionary entries found in that text.

    The forms 'inline' (a constant) and 'join' give the same matches; 'auto' takes the first for a dictionary measured small.
    """
    if how == "auto":
        how = "inline" if is_small(dictionary, INLINE_ROWS, INLINE_BYTES) else "join"
    if how == "inline":
        return _inline(df, dictionary, texts)
    if how == "join":
        return _joined(df, dictionary, texts)
    raise ValueError(f"how must be 'auto', 'inline' or 'join', not {how!r}")


def of_kind(found: str, kind: str | None) -> str:
    return found if kind is None else f"filter({found}, e -> e.kind = '{kind}')"


def joined_values(found: str, field: str, kind: str | None = None) -> Column:
    """Distinct values of one entry field of an array column in order, ', ' between; NULL when there is none."""
    values = f"filter(transform({of_kind(found, kind)}, e -> e.{field}), v -> v IS NOT NULL)"
    return F.expr(f"CASE WHEN size({values}) > 0 THEN array_join(array_sort(array_distinct({values})), ', ') END")


def any_found(found: str, kind: str | None = None) -> Column:
    """Whether an array column of entries holds one (of a kind)."""
    return F.expr(f"coalesce(size({of_kind(found, kind)}) > 0, false)")
