"""Text tests, keyword flags, snippets and display forms."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from pressgrid.functions.binding import let
from pressgrid.functions.urls import strip

# The two keyword families.
KILL_PILL = ["incubator", "孵化器", "孵化场", "孵化中心"]
UNWANTED = ["accelerator", "startup factory", "孵化器工厂"]

_ASCII_WORD = "[0-9A-Za-z_]"

PLACEHOLDER = "needs enrichment"
GUARD_LENGTH = 20


def _bounded(word: str, boundary: str) -> str:
    """A lower-case word with an edge on both sides. The word comes first and is then looked back
    at, so the matcher can skip ahead on the literal."""
    quoted = re.escape(word)
    if boundary == "unicode":
        return rf"(?U)\b{quoted}\b"
    if boundary != "ascii":
        raise ValueError(f"boundary must be 'ascii' or 'unicode', not {boundary!r}")
    # an edge lies between a word and a non-word character: which one must stand
    # outside depends on the character inside
    before = "!" if re.match(_ASCII_WORD, word[0]) else "="
    after = "!" if re.match(_ASCII_WORD, word[-1]) else "="
    return f"{quoted}(?<{before}{_ASCII_WORD}{quoted})(?{after}{_ASCII_WORD})"


def words_pattern(words: list[str], boundary: str = "ascii") -> str:
    """Whole-word alternation. 'ascii' sees no edge inside CJK text; 'unicode' does."""
    return "|".join(_bounded(w.lower(), boundary) for w in words)


def _lowered(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def holds_any(lowered: Column, words: list[str]) -> Column:
    """Cheap test that spares most texts the pattern: one of the words occurs somewhere."""
    return reduce(or_, [lowered.contains(w.lower()) for w in words])


def _word_in(lowered: Column, words: list[str], boundary: str) -> Column:
    return holds_any(lowered, words) & lowered.rlike(words_pattern(words, boundary))


def has_word(c: Column, words: list[str], boundary: str = "ascii") -> Column:
    return _word_in(_lowered(c), words, boundary)


def count_words(c: Column, words: list[str], boundary: str = "ascii") -> Column:
    return _count_in(_lowered(c), words, boundary)


def _count_in(lowered: Column, words: list[str], boundary: str) -> Column:
    counted = F.regexp_count(lowered, F.lit(words_pattern(words, boundary)))
    return F.when(holds_any(lowered, words), counted).otherwise(0).cast("long")


def word_context(c: Column, words: list[str], boundary: str = "ascii", lowered: Column | None = None) -> Column:
    """Sentences (split at '.') holding a word, untrimmed, in text order; NULL when there is none."""
    low = _lowered(c) if lowered is None else lowered
    marked = F.zip_with(
        F.split(c, r"\."), F.split(low, r"\."), lambda s, l: F.when(_word_in(l, words, boundary), s))
    found = F.when(holds_any(low, words), F.array_join(marked, " | "))  # NULL entries are skipped
    return F.nullif(found, F.lit(""))


def keyword_flags(
    c: Column, prefix: str, words: list[str], boundary: str = "ascii", lowered: Column | None = None,
) -> dict[str, Column]:
    """The flag, count and context columns of one keyword family; `lowered` saves lowering the text again."""
    low = _lowered(c) if lowered is None else lowered
    return {
        prefix: _word_in(low, words, boundary),
        f"{prefix}_count": _count_in(low, words, boundary),
        f"{prefix}_context": word_context(c, words, boundary, low),
    }


def detect_language(content: Column, current: Column | None = None) -> Column:
    """'zh' where a Han character occurs, else 'en'; a stored language wins."""
    found = F.when(F.coalesce(content, F.lit("")).rlike(r"\p{IsHan}"), "zh").otherwise("en")
    return found if current is None else F.coalesce(current, found)


def tag_brand(
    title: Column, content: Column, fund: Column, brand: str,
    current: Column | None = None, boundary: str = "ascii",
) -> Column:
    """Brand as a whole word in title or content, or as the managing fund; `current` given = keep it."""
    tagged = (
        has_word(content, [brand], boundary) | has_word(title, [brand], boundary)
        | (_lowered(fund) == brand.lower())
    )
    return tagged if current is None else F.coalesce(current, tagged)


def mentions_brand(brand: str, *cols: Column) -> Column:
    """Brand as a plain substring of any of the columns."""
    return reduce(or_, [_lowered(c).contains(brand.lower()) for c in cols])


def passes_guard(content: Column, minimum: int = GUARD_LENGTH) -> Column:
    """Long enough to be enriched."""
    return F.length(F.trim(F.coalesce(content, F.lit("")))) >= minimum


def _cut_at_sentence(text: Column, limit: int, floor: int) -> Column:
    """Cut a text longer than `limit`: after the last '. ', else '! ', else '? ' beyond `floor`, else at `limit`."""
    def shortened(long: Column) -> Column:
        backwards = F.reverse(F.substr(long, F.lit(1), F.lit(limit)))
        cuts = []
        for mark in (". ", "! ", "? "):
            at = F.locate(mark[::-1], backwards)  # from the end, 0 when absent
            place = F.lit(limit) - at - (len(mark) - 1)  # 0-based place of the last occurrence
            cuts.append(F.when((at > 0) & (place > floor), place + 1))
        return F.substr(long, F.lit(1), F.coalesce(*cuts, F.lit(limit)))

    return let(text, lambda t: F.when(F.length(t) > limit, shortened(t)).otherwise(t))


def key_snippet(content: Column, words: list[str]) -> Column:
    """Sentences around keyword hits: about five, at most ~500 characters; without a hit the first three.

    Hits are found over the whole text; the fold only walks the hits.
    """
    sought = [w.lower() for w in words if w]

    def hit(sentence: Column) -> Column:
        return holds_any(F.lower(sentence), sought) if sought else F.lit(False)

    def around(sentences: Column) -> Column:
        def frame(s: Column, i: Column) -> Column:
            prev = F.when(i > 0, F.get(sentences, i - 1))
            return F.when(hit(s), F.struct(s.alias("now"), prev.alias("prev"), F.get(sentences, i + 1).alias("next")))

        hits = F.filter(F.transform(sentences, frame), lambda f: f.isNotNull())

        def add(kept: Column, f: Column) -> Column:
            lead = F.when(f["prev"].isNull() | F.array_contains(kept, f["prev"]), F.array(f["now"])) \
                .otherwise(F.array(f["prev"], f["now"]))
            grown = F.concat(kept, lead)
            full = F.when(f["next"].isNotNull() & (F.size(grown) < 5), F.concat(grown, F.array(f["next"]))) \
                .otherwise(grown)
            return F.when(F.size(kept) >= 5, kept).otherwise(full)

        picked = F.aggregate(hits, F.array().cast("array<string>"), add)
        opening = F.array_join(F.slice(sentences, 1, 3), " ")
        return let(picked, lambda p: F.when(F.size(p) > 0, _cut_at_sentence(F.array_join(p, " "), 500, 200))
                   .otherwise(_cut_at_sentence(opening, 300, 100)))

    def whole(text: Column) -> Column:
        sentences = let(F.split(text, r"(?<=[.!?])\s+"), around)
        return F.when(text == "", text).otherwise(sentences)

    return let(F.coalesce(content, F.lit("")), whole)


def shorten(c: Column, limit: int, empty: str | None = None) -> Column:
    """Display form: the first `limit` characters and '...'; `empty` replaces NULL and ''."""
    short = F.when(F.length(c) > limit, F.concat(F.substr(c, F.lit(1), F.lit(limit)), F.lit("..."))).otherwise(c)
    return short if empty is None else F.when(c.isNull() | (c == ""), F.lit(empty)).otherwise(short)


def truncate_text(c: Column, limit: int, marker: str = "") -> Column:
    """Storage cap, with a marker where text was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substr(c, F.lit(1), F.lit(limit)), F.lit(marker))).otherwise(c)


def flatten_quotes(c: Column, limit: int) -> Column:
    """Capped text with double quotes made single and line breaks made blanks."""
    return F.translate(F.substr(c, F.lit(1), F.lit(limit)), '"\n', "' ")


def sanitize_text(c: Column) -> Column:
    """Trimmed text without < > \" and '."""
    return F.coalesce(F.translate(strip(c), "<>\"'", ""), F.lit(""))


def as_text(c: Column, empty: str) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(empty)).otherwise(c)


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def unbranded_win(companies: Column, brand_in_headline: Column) -> Column:
    """A portfolio company is named and the brand is not in the headline."""
    return F.coalesce(companies != "", F.lit(False)) & ~F.coalesce(brand_in_headline, F.lit(False))
