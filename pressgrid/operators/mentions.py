"""Social mentions: filters, share counts and matching to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions.urls import any_of, extract_urls, is_article_url, match_url
from pressgrid.operators.grams import contained
from pressgrid.operators.lookup import lookup, salted_join
from pressgrid.session import settle

# Platforms a mention may come from (substring of its URL).
PLATFORMS = ["x.com", "twitter.com"]

# Words that make a mention relevant, besides the brand's own.
CONTEXT_WORDS = [
    "startup", "startups", "founder", "founders", "vc", "venture", "investment", "investor", "accelerator",
    "incubator", "portfolio", "funding", "seed", "pre-seed", "series a", "raise", "raising", "pitch",
    "residency", "cohort", "batch", "demo day",
]
# Publications that make a mention relevant.
PUBLICATIONS = [
    "techcrunch", "wsj", "forbes", "bloomberg", "reuters", "ft.com", "cnbc", "businessinsider", "fortune",
    "wired", "theverge", "venturebeat", "axios", "sifted", "eu-startups", "techinasia", "dealstreetasia",
    "e27", "yourstory", "inc42", "technode", "straitstimes", "scmp", "nikkei", "economist", "guardian", "bbc",
    "nytimes", "washingtonpost", "fastcompany", "inc.com", "entrepreneur", "zdnet", "cnet", "mashable",
    "arstechnica", "afr", "theaustralian", "channelnewsasia", "economictimes", "livemint", "bangkokpost",
    "koreaherald", "japantimes", "handelsblatt",
]
# Words that make a mention irrelevant, besides the brand's own.
NOISE_WORDS = [
    "deer", "elk", "moose", "caribou", "reindeer", "hunting", "hunter", "luggage", "suitcase", "bag",
    "travel", "taxidermy", "horn", "bone", "decor", "yellowjackets", "chew", "dog", "pet", "game", "gaming",
    "video game", "playing cards", "deck", "cards", "restaurant", "kitchen", "bar", "food", "menu", "costume",
    "headband", "hat", "cosplay", "furry", "tornado", "weather", "storm",
]


def context_words(brand: str, people: list[str] | None = None) -> list[str]:
    return CONTEXT_WORDS + PUBLICATIONS + [f"{brand}global", f"@{brand}"] + [p.lower() for p in people or []]


def noise_words(brand: str) -> list[str]:
    return NOISE_WORDS + [f"red {brand}"]


def _holds(text: Column, words: list[str], match: str) -> Column:
    if match == "substring":
        return any_of(text, words)
    if match == "word":
        padded = F.concat(F.lit(" "), text, F.lit(" "))
        body = "|".join(r"\Q" + w + r"\E" for w in words)
        return padded.rlike(f"[^a-z0-9](?:{body})[^a-z0-9]")
    raise ValueError(f"match must be 'substring' or 'word', not {match!r}")


def mention_stages(
    mentions: DataFrame, brand: str, people: list[str] | None = None, match: str = "substring",
) -> DataFrame:
    """Adds on_platform, foreign, relevant: each stage implies the ones before it."""
    brand = brand.lower()
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    platform = any_of(F.coalesce("url", F.lit("")), PLATFORMS)
    own = F.lower(F.coalesce("author_name", F.lit(""))).contains(brand) | \
        F.lower(F.coalesce("author_url", F.lit(""))).contains(brand)
    relevant = ~_holds(text, noise_words(brand), match) & _holds(text, context_words(brand, people), match)
    return mentions.withColumns({
        "on_platform": platform, "foreign": platform & ~own, "relevant": platform & ~own & relevant})


def relevant_mentions(mentions: DataFrame, brand: str, **options) -> DataFrame:
    return mention_stages(mentions, brand, **options).filter("relevant").select(*mentions.columns)


def mention_urls(mentions: DataFrame, match: str = "substring") -> DataFrame:
    """Article URLs in title and summary, one row per occurrence, in matching form."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    return (
        mentions.select(F.explode(extract_urls(text)).alias("raw"))
        .filter(is_article_url(F.col("raw"), match))
        .select(match_url(F.col("raw")).alias("mention_url")).filter(F.col("mention_url") != "")
    )


def url_counts(urls: DataFrame) -> DataFrame:
    """Occurrences per mention URL."""
    return urls.groupBy("mention_url").agg(F.count("*").alias("shares"))


def article_keys(articles: DataFrame) -> DataFrame:
    """Id and matching form of the URL of every article that can be updated (it has both)."""
    keyed = articles.select("id", match_url(F.col("url")).alias("article_url"))
    return keyed.filter(F.col("id").isNotNull() & (F.col("article_url") != ""))


def match_exact(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """Mention URLs equal to an article URL (smallest id), with their shares."""
    keys = article_keys(articles).withColumnRenamed("article_url", "mention_url")
    # the mention URLs go to the articles when few; copies of an article are folded map-side
    hits = lookup(keys, counts, "mention_url", "inner", spread=["id"])
    return hits.groupBy("mention_url").agg(F.min("shares").alias("shares"), F.min("id").alias("id")) \
        .withColumn("article_url", F.col("mention_url"))


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def _tails(url: Column) -> Column:
    """The URL itself and every URL embedded in it (from each further scheme on)."""
    parts = F.split(url, "https://")
    embedded = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.concat(F.lit("https://"), F.array_join(F.slice(parts, i, F.size(parts)), "https://")))
    return F.when(F.size(parts) >= 2, embedded).otherwise(F.array(url))


def _pieces(df: DataFrame, url: str, lengths: DataFrame) -> DataFrame:
    """Every start, of a length that occurs in `lengths`, of the URL and of the URLs embedded in it."""
    sizes = lengths.agg(F.collect_set("n")).scalar()  # at most one entry per URL length
    return (
        df.withColumn("_sizes", sizes).withColumn("_tail", F.explode(_tails(_with_scheme(F.col(url)))))
        .withColumn("_size", F.explode(F.filter("_sizes", lambda n: n <= F.length("_tail"))))
        .withColumn("piece", F.substr("_tail", F.lit(1), F.col("_size"))).drop("_sizes", "_tail", "_size")
    )


def match_partial(counts: DataFrame, articles: DataFrame, exact: DataFrame | None = None, mode: str = "substring") -> DataFrame:
    """For mention URLs equal to no article: the article whose URL contains or is contained in the mention's.

    The longest shared text wins, then the smallest id. `mode` 'substring' finds one URL anywhere in the
    other (`contained`); 'start' only where it starts the other or a URL embedded in it.
    """
    exact = match_exact(counts, articles) if exact is None else exact
    open_counts = counts.join(exact.select("mention_url"), "mention_url", "left_anti")
    if mode == "start":
        return _match_starts(open_counts, articles)
    if mode != "substring":
        raise ValueError(f"mode must be 'substring' or 'start', not {mode!r}")
    wanted = settle(open_counts)
    # copies of an article are folded first; each URL is one row then
    stored = settle(article_keys(articles).groupBy("article_url").agg(F.min("id").alias("id")))
    inside = contained(stored, "article_url", wanted.select("mention_url"), "mention_url").select("mention_url", "article_url")
    around = contained(wanted, "mention_url", stored, "article_url").select("mention_url", "article_url", "id")
    # the shared text of the first direction is the whole mention, so it wins over the second
    inner = salted_join(inside, stored, "article_url", "inner").groupBy("mention_url").agg(F.min_by(F.struct("id", "article_url"), "id").alias("_a"))
    outer = around.groupBy("mention_url").agg(
        F.max_by(F.struct("id", "article_url"), F.struct(F.length("article_url").alias("n"), (-F.col("id")).alias("i"))).alias("_b"))
    return (
        wanted.join(inner, "mention_url", "left").join(outer, "mention_url", "left")
        .withColumn("_m", F.coalesce("_a", "_b")).filter(F.col("_m").isNotNull())
        .select("mention_url", "shares", "_m.id", "_m.article_url")
    )


def _match_starts(open_counts: DataFrame, articles: DataFrame) -> DataFrame:
    """URLs start with a scheme (given to those without), so one starts the other or a URL embedded in it.

    Both directions are key joins on such starts: work grows with the number of
    URLs, not with their pairs, however many share a host.
    """
    keys = article_keys(articles)
    wanted = open_counts.select("mention_url", _with_scheme(F.col("mention_url")).alias("piece"))
    stored = keys.withColumn("piece", _with_scheme(F.col("article_url")))

    def smallest(candidates: DataFrame, by: str) -> DataFrame:
        return candidates.groupBy(by).agg(F.min_by(F.struct("id", "article_url"), "id").alias("_a"))

    # mention inside article: the shared text is the whole mention, so this direction wins
    starts = _pieces(keys, "article_url", wanted.select(F.length("piece").alias("n")))
    inside = smallest(lookup(starts, wanted, "piece", "inner", spread=["id"]), "mention_url")
    # article inside mention: longest article, then smallest id
    pieces = _pieces(open_counts.select("mention_url"), "mention_url", stored.select(F.length("piece").alias("n")))
    present = smallest(lookup(stored, pieces.select("piece").distinct(), "piece", "left_semi", spread=["id"]), "piece")
    around = (
        lookup(pieces, present, "piece", "inner").groupBy("mention_url")
        .agg(F.max_by("_a", F.struct(F.length("piece").alias("n"), (-F.col("_a.id")).alias("i"))).alias("_b"))
    )
    return (
        open_counts.join(inside, "mention_url", "left").join(around, "mention_url", "left")
        .withColumn("_m", F.coalesce("_a", "_b")).filter(F.col("_m").isNotNull())
        .select("mention_url", "shares", "_m.id", "_m.article_url")
    )


def match_mentions(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """Exact matches, then partial ones for the rest."""
    exact = match_exact(counts, articles)
    return exact.withColumn("match_kind", F.lit("exact")).unionByName(
        match_partial(counts, articles, exact).withColumn("match_kind", F.lit("partial")))


def add_shares(articles: DataFrame, matches: DataFrame) -> DataFrame:
    """Share counts raised by the sum over all mention URLs that hit the article."""
    added = matches.groupBy("id").agg(F.sum("shares").alias("_added"))
    joined = lookup(articles, added, "id", spread=["url", "updated_at"])
    total = F.coalesce("social_shares_count", F.lit(0)) + F.col("_added")
    return joined.withColumn(
        "social_shares_count", F.coalesce(total, F.col("social_shares_count"))).select(*articles.columns)


def mention_funnel(mentions: DataFrame, articles: DataFrame, brand: str) -> DataFrame:
    """Mentions left after each stage, distinct article URLs and matched URLs."""
    staged = mention_stages(mentions, brand)
    counts = settle(url_counts(mention_urls(staged.filter("relevant"))))
    urls = counts.agg(F.count("*")).scalar()
    matched = match_mentions(counts, articles).agg(F.count("*")).scalar()
    return staged.agg(
        F.count("*").alias("fetched"), F.count_if("on_platform").alias("platform"),
        F.count_if("foreign").alias("not_own"), F.count_if("relevant").alias("with_context"),
    ).withColumns({"urls_found": urls, "matched": matched})
