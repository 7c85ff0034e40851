"""URL and domain forms. Each serves its own comparison; they are not interchangeable."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Sites behind a paywall (matched as substrings of the host).
PAYWALLED_SITES = [
    "wsj.com", "ft.com", "nytimes.com", "economist.com", "bloomberg.com", "barrons.com",
    "telegraph.co.uk", "thetimes.co.uk", "washingtonpost.com", "hbr.org", "fortune.com",
    "techinasia.com", "sifted.eu",
]

# Social sites whose links are not articles (matched as substrings of the URL).
SOCIAL_SITES = [
    "twitter.com", "x.com", "t.co", "facebook.com", "instagram.com", "linkedin.com", "youtube.com",
    "tiktok.com", "reddit.com",
]

# What counts as a URL inside free text.
URL_IN_TEXT = r'https?://[^\s<>"{}|\\^`\[\]]+'

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.trim(c, F.lit(WHITESPACE))


def any_of(c: Column, words: list[str]) -> Column:
    """True where one of the words occurs in the column."""
    return c.rlike("|".join(re.escape(w) for w in words))


def normalize_url(c: Column) -> Column:
    """Storage form: https:// by default, no trailing slash, no leading `www.`; case and query kept."""
    u = F.regexp_replace(strip(c), "^/(?=.)", "")
    u = F.regexp_replace(u, "^(?!https?://)", "https://")
    u = F.regexp_replace(u, r"(?s)^(?!https?://\z)(.*?)/+\z", "$1")
    u = F.replace(u, F.lit("://www."), F.lit("://"))
    return F.when(c.isNull() | (c == ""), c).otherwise(u)


def match_url(c: Column) -> Column:
    """Mention-matching form: no query, fragment, trailing slash, `www.`; https, lower case."""
    u = F.regexp_replace(c, r"(?s)[?#].*$", "")
    u = F.regexp_replace(u, "/+$", "")
    u = F.replace(F.replace(u, F.lit("http://"), F.lit("https://")), F.lit("www."), F.lit(""))
    return F.coalesce(F.lower(u), F.lit(""))


def cleaned_url(c: Column) -> Column:
    """Enrichment form: no scheme, `www.` or query, one trailing slash dropped, lower case; fragment stays."""
    u = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/$", "")


def cleaned_url_keep_scheme(c: Column) -> Column:
    """Ingest form: query and fragment cut, all else kept."""
    return F.regexp_replace(F.regexp_replace(c, r"\?.*", ""), "#.*", "")


def domain_from_url(c: Column) -> Column:
    """Network location in lower case without a leading `www.` (port and user part stay)."""
    netloc = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(netloc, r"^www\.", "")


def known_domain(domain: Column, url: Column) -> Column:
    """The stored domain in lower case, or the host taken from the URL."""
    host = F.nullif(
        F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:www\.)?([^/]+)", 1), F.lit(""))
    return F.coalesce(F.lower(F.nullif(F.trim(domain), F.lit(""))), host)


def normalize_domain(c: Column) -> Column:
    """Join form of a domain: `www.` removed anywhere, lower case."""
    return F.lower(F.replace(c, F.lit("www."), F.lit("")))


def extract_urls(c: Column) -> Column:
    """All URLs in a text, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL_IN_TEXT), F.lit(0))


def _site_test(c: Column, sites: list[str], match: str) -> Column:
    if match == "substring":
        return any_of(F.lower(c), sites)
    if match == "host":
        tail = "|".join(re.escape(s) for s in sites)
        return domain_from_url(c).rlike(rf"(^|\.)({tail})(:\d+)?$")
    raise ValueError(f"match must be 'substring' or 'host', not {match!r}")


def is_article_url(c: Column, match: str = "substring") -> Column:
    """Not a social-network link. 'substring' also rejects hosts that merely contain a listed site."""
    return ~_site_test(c, SOCIAL_SITES, match)


def is_paywalled(url: Column, match: str = "substring") -> Column:
    """On one of the paywalled sites."""
    if match == "substring":
        return any_of(domain_from_url(url), PAYWALLED_SITES)
    return _site_test(url, PAYWALLED_SITES, match)
