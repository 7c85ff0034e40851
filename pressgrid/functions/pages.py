"""Article fields from fetched pages (HTML) and from Markdown renderings of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.binding import let
from pressgrid.functions.dates import parse_date
from pressgrid.functions.text import key_snippet, truncate_text
from pressgrid.functions.urls import domain_from_url, strip

PARAGRAPH_MIN = 20
BODY_MIN = 100

# Where a page states its publication date, in order of preference.
DATE_PLACES = [
    r'"datePublished"\s*:\s*"([^"]+)"',
    r"""(?i)<meta[^>]*property=["']article:published_time["'][^>]*content=["']([^"'>]+)["']""",
    r"""(?i)<meta[^>]*name=["']pubdate["'][^>]*content=["']([^"'>]+)["']""",
    r"""(?i)<meta[^>]*name=["']date["'][^>]*content=["']([^"'>]+)["']""",
    r"""(?i)<time[^>]*datetime=["']([^"'>]+)["']""",
]

# Character entities decoded in extracted text (&amp; last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

# Markdown lines holding one of these are page furniture.
CHROME_MARKS = [
    "- [Premium]", "- [Visuals]", "- [News]", "- [Paid Partnership]", "- [Press Releases]", "- More",
    "[Free newsletter]", "[Subscribe]", "Tired of ads?", "signing up", "Premium Content",
    "It takes our newsroom", "You can't find them", "anywhere else", "This is premium content",
    "Subscribe to read", "We know this is not ideal", "Sign up in 20 seconds", "Cancel anytime",
    "For learners", "For professionals", "Best value", "Billed annually", "Get instant access",
    "premium content", "Unlimited news content", "Unlimited company database", "Ad-free reading",
    "Just US$", "[Compare]", "[Subscribe now", "Already a subscriber", "[Log in Here]",
    "Our subscriber community", "### [🏆 Premium", "### [💼 Latest Jobs", "📅 Upcoming Events",
    "More articles ↓", "NextPrev", "Featured", "TIA Writer", "· 2d ago ·", "· 1d ago ·", "· 3d ago ·",
    "min read",
]
# Job advertisements inside a page.
JOB_MARKS = ["**Mandarin Teacher**", "**Online Sales", "IDR "]
# The first line holding one of these ends the article.
END_MARKS = [
    "## Stay ahead in Asia", "This is premium content. Subscribe", "### [🏆 Premium Content]",
    "### [💼 Latest Jobs]",
]
IMAGE_PLACEHOLDER = "<Base64-Image-Removed>"


def plain_text(html: Column) -> Column:
    """Tags out, common entities decoded, outer white space trimmed."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(text)


def page_title(html: Column) -> Column:
    """The <title>, else the first <h1>, else NULL."""
    title = plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heading = plain_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")))


def page_publish_date(html: Column, as_of: Column) -> Column:
    """First date place that holds a readable date, else the processing date."""
    found = [parse_date(F.regexp_extract(html, place, 1)) for place in DATE_PLACES]
    return F.coalesce(*found, as_of).cast("date")


def page_body(html: Column) -> Column:
    """Paragraphs of the <article> (else of the page) over 20 characters, blank line between; NULL below 100."""
    def joined(source: Column) -> Column:
        blocks = F.regexp_extract_all(source, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
        return F.array_join(F.filter(F.transform(blocks, plain_text), lambda p: F.length(p) > PARAGRAPH_MIN), "\n\n")

    article = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    source = let(article, lambda a: F.when(a.rlike("(?i)<p[ >]"), a).otherwise(html))
    return let(let(source, joined), lambda body: F.when(F.length(body) >= BODY_MIN, body))


def extract_pages(
    pages: DataFrame, mode: str, as_of: Column, words: list[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """page_id, url, domain, title, publish_date, content at one of three depths.

    'metadata' never touches the body, 'light' keeps key sentences around `words`,
    'full' keeps the whole body, or its first `limit` characters with a mark.
    """
    html, title, body = F.col("html"), F.col("_title"), F.col("_body")
    found = pages.select(
        "page_id", "url", page_title(html).alias("_title"), page_publish_date(html, as_of).alias("publish_date"),
        *([] if mode == "metadata" else [page_body(html).alias("_body")]))
    if mode == "metadata":
        content, title = F.lit(None).cast("string"), F.coalesce(title, F.lit("No title"))
    elif mode == "light":
        found = found.withColumn("_snippet", key_snippet(body, words or []))
        content = F.col("_snippet")
        title = F.coalesce(title, _lead(content))
    elif mode == "full":
        content = body if limit is None else truncate_text(body, limit)
        title = F.coalesce(title, F.get(F.split(body, "\n"), F.lit(0)))
    else:
        raise ValueError(f"mode must be 'metadata', 'light' or 'full', not {mode!r}")
    return found.select(
        "page_id", "url", domain_from_url(F.col("url")).alias("domain"), title.alias("title"), "publish_date",
        content.alias("content"))


def _lead(text: Column) -> Column:
    return F.when(F.length(text) > 100, F.concat(F.substr(text, F.lit(1), F.lit(100)), F.lit("..."))) \
        .otherwise(F.nullif(text, F.lit("")))


def prefer_longer(first: Column, second: Column, minimum: int = BODY_MIN) -> Column:
    """The second text where the first is missing or short and the second is longer."""
    size = F.length(F.coalesce(first, F.lit("")))
    use = ((size < minimum) & (F.length(second) > size))
    return F.when(use, second).otherwise(first)


def _present(text: Column, marks: list[str]) -> Column:
    """The marks that occur in the whole text: lines are then tested for these only."""
    return F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: text.contains(m))


def _holds(line: Column, marks: Column) -> Column:
    return F.exists(marks, lambda m: line.contains(m))


def _is_link_or_image(bare: Column) -> Column:
    """A trimmed line that is an image, a short link or a row of links."""
    image = (
        bare.startswith("![") & bare.endswith(")") & (F.length(bare) < 200)
        & ~F.substr(bare, F.lit(4), F.lit(47)).contains("/")
    )
    label = F.substr(F.substring_index(bare, "](", 1), F.lit(2))
    link = bare.startswith("[") & bare.endswith(")") & bare.contains("](") & (F.length(label) < 50)
    many = bare.contains("](http") & (F.regexp_count(bare, F.lit(r"\]\(http")) > 2)
    return image | link | many


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def _drop_repeated_title(text: Column) -> Column:
    """Lines before the first `# ` heading that repeat it."""
    def clean(lines: Column) -> Column:
        numbered = F.transform(lines, lambda l, i: F.struct(strip(l).alias("s"), i.alias("i")))
        head = F.get(F.filter(numbered, lambda n: n["s"].startswith("# ")), F.lit(0))
        return let(head, lambda h: F.when(
            (F.size(lines) > 2) & h.isNotNull(),
            let(strip(F.substr(h["s"], F.lit(3))), lambda title: F.filter(
                lines, lambda l, i: ~((i < h["i"]) & (strip(l) == title))))).otherwise(lines))

    return F.array_join(let(F.split(text, "\n"), clean), "\n")


def strip_page_chrome(markdown: Column) -> Column:
    """Article text of a Markdown page: furniture lines out, links to text, images out, title once."""
    def article_lines(text: Column) -> Column:
        def until_end(lines: Column) -> Column:
            stop = let(_present(text, END_MARKS), lambda ends: F.array_position(
                F.transform(lines, lambda l: _holds(l, ends)), F.lit(True)))  # 1-based, 0 when absent
            return let(stop, lambda s: F.when(s > 0, F.slice(lines, F.lit(1), (s - 1).cast("int"))).otherwise(lines))

        kept = let(F.split(text, "\n"), until_end)
        return let(_present(text, CHROME_MARKS + JOB_MARKS), lambda marks: F.filter(
            kept, lambda l: ~(_holds(l, marks) | let(strip(l), _is_link_or_image))))

    kept = let(markdown, article_lines)
    # leading blank lines would survive only in front of the text, where the last trim removes them
    text = _squeeze(F.array_join(kept, "\n"))
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", "")
    text = F.replace(text, F.lit(IMAGE_PLACEHOLDER), F.lit(""))
    return F.coalesce(strip(_squeeze(_drop_repeated_title(text))), F.lit(""))
