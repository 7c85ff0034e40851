"""Edge cases of the column expressions."""

import datetime as dt

from pyspark.sql import functions as F

from pressgrid.functions import dates, pages, text, urls, validation
from pressgrid.operators.domains import derive_tier


def test_normalize_url(one):
    cases = {
        None: None, "": "", "  ": "https://", "/host.org/x": "https://host.org/x", "/": "https:",
        "HTTP://A.org/X": "https://HTTP://A.org/X", "https://": "https://", "http://a.org///": "http://a.org",
        "https://www.a.org/": "https://a.org", "a.org/www.b": "https://a.org/www.b", "\thttps://a.org/?q=1/ ": "https://a.org/?q=1",
        "https://www.www.a.org": "https://www.a.org", "a.org:80/P": "https://a.org:80/P",
    }
    assert one(list(cases), urls.normalize_url) == list(cases.values())


def test_match_url(one):
    cases = {
        None: "", "": "", "http://WWW.a.org/x/?q#f": "https://www.a.org/x", "http://www.a.org/x/": "https://a.org/x",
        "https://a.org/x#f?q": "https://a.org/x", "https://a.org/www.x//": "https://a.org/x", "?q": "",
    }
    assert one(list(cases), urls.match_url) == list(cases.values())


def test_cleaned_urls(one):
    given = ["https://www.A.org/x/?q=1", "http://a.org/#top", " a.org// ", None]
    assert one(given, urls.cleaned_url) == ["a.org/x", "a.org/#top", "a.org/", None]
    given = ["https://A.org/x?q#f", "https://a.org/x#f?q", "a"]
    assert one(given, urls.cleaned_url_keep_scheme) == ["https://A.org/x", "https://a.org/x", "a"]


def test_domains(one):
    given = ["https://www.A.org:8080/x", "https://u:p@a.org", "a.org/x", "https://a.www.org?x", ""]
    assert one(given, urls.domain_from_url) == ["a.org:8080", "u:p@a.org", "", "a.www.org", ""]
    assert one(["WWW.a.org", "awww.b.org", "www.A.www.org"], urls.normalize_domain) == ["www.a.org", "ab.org", "a.org"]


def test_site_tests(one):
    given = ["https://microsoft.com/a", "https://t.co/x", "https://news.org", "https://sub.x.com/a"]
    assert one(given, urls.is_article_url) == [False, False, True, False]
    assert one(given, lambda c: urls.is_article_url(c, "host")) == [True, False, True, False]
    paid = ["https://www.ft.com/a", "https://soft.com", "https://wsj.com:80"]
    assert one(paid, urls.is_paywalled) == [True, True, True]
    assert one(paid, lambda c: urls.is_paywalled(c, "host")) == [True, False, True]


def test_extract_urls(one):
    given = ["see http://a.b/c, <https://d.e/f> \"https://g.h\"", None, "none"]
    assert one(given, urls.extract_urls) == [["http://a.b/c,", "https://d.e/f", "https://g.h"], [], []]


def test_language(one):
    assert one(["abc", "a 孵 b", None, ""], text.detect_language) == ["en", "zh", "en", "en"]


def test_whole_words(one):
    given = ["the Brand.", "brands", "x_brand", "re-brand!", "a孵化器b", "中 孵化器 在", None, "brand孵化器", "BRAND"]
    assert one(given, lambda c: text.has_word(c, ["brand"])) == [True, False, False, True, False, False, False, True, True]
    assert one(given, lambda c: text.has_word(c, ["孵化器"])) == [False] * 4 + [True] + [False] * 4
    assert one(given, lambda c: text.has_word(c, ["孵化器"], "unicode"))[4:6] == [False, True]


def test_keyword_counts_and_context(one):
    given = ["An incubator. No hit here. INCUBATOR incubators incubator", "none", None, "incubator"]
    assert one(given, lambda c: text.count_words(c, text.KILL_PILL)) == [3, 0, 0, 1]
    assert one(given, lambda c: text.word_context(c, text.KILL_PILL)) == [
        "An incubator |  INCUBATOR incubators incubator", None, None, "incubator"]


def test_snippet_sentences(one):
    def snip(*values):
        return one(list(values), lambda c: text.key_snippet(c, ["hit"]))
    assert snip(None, "") == ["", ""]
    assert snip("One. Two! Three? Four.") == ["One. Two! Three?"]
    assert snip("Hit one. Two. Three.") == ["Hit one. Two."]
    assert snip("One. Two. A hit.") == ["Two. A hit."]
    assert snip("no punctuation with hit") == ["no punctuation with hit"]
    # the previous sentence is already there the second time; the sentence after is repeated
    assert snip("A. hit b. hit c. D. E.") == ["A. hit b. hit c. hit c. D."]
    assert snip("A. hit b. C. hit d. E. hit f. G.") == ["A. hit b. C. hit d. E."]


def test_snippet_cut(one):
    long = "hit " + "x" * 250 + ". " + "y" * 300 + "! tail"
    assert one([long], lambda c: text.key_snippet(c, ["hit"])) == ["hit " + "x" * 250 + "."]
    late = "hit " + "x" * 250 + "! " + "y" * 300 + "?"
    assert one([late], lambda c: text.key_snippet(c, ["hit"])) == ["hit " + "x" * 250 + "!"]
    assert one(["hit" + "z" * 600], lambda c: text.key_snippet(c, ["hit"])) == ["hit" + "z" * 497]
    assert one(["w" * 600], lambda c: text.key_snippet(c, ["hit"])) == ["w" * 300]


def test_display(one):
    assert one(["abcdef", "abc", "", None], lambda c: text.shorten(c, 3)) == ["abc...", "abc", "", None]
    assert one(["abcdef", "", None], lambda c: text.shorten(c, 3, "No title")) == ["abc...", "No title", "No title"]
    assert one([" <a href='x'>\"b\" ", None], text.sanitize_text) == ["a href=xb", ""]
    assert one(['a"b\nc', None], lambda c: text.flatten_quotes(c, 4)) == ["a'b ", None]


def test_dates(one):
    day = dt.datetime(2025, 9, 22)
    given = ["22 Sep 2025", "2025-09-22", "NA", "", "2025-02-30", "2025-09-22T10:00:00+00:00", None]
    assert one(given, dates.parse_date) == [day, day, None, None, None, dt.datetime(2025, 9, 22, 10), None]


def test_tiers(one):
    assert one([None, 0, 4, 5, 6, 7, 9], derive_tier, "long") == [
        None, "Tier 3", "Tier 3", "Tier 2", "Tier 2", "Tier 1", "Tier 1"]


def test_page_dates(one):
    as_of = F.lit("2020-01-01").cast("timestamp")
    given = [
        '<script>{"datePublished" : "2024-01-02T03:04:05"}</script>',
        "<META property='article:published_time' x content='2024-02-03'>",
        '<meta name="pubdate" content="2024-03-04">', '<meta name="date" content="05 Apr 2024">',
        '<time class="x" datetime="2024-05-06 07:08:09">', '{"datePublished":"soon"}<time datetime="2024-06-07">', "<p>none</p>",
    ]
    days = [(2024, 1, 2), (2024, 2, 3), (2024, 3, 4), (2024, 4, 5), (2024, 5, 6), (2024, 6, 7), (2020, 1, 1)]
    assert one(given, lambda c: pages.page_publish_date(c, as_of)) == [dt.date(*d) for d in days]


def test_page_title_and_body(one):
    given = ["<title> A &amp; B </title>", "<title></title><h1 class=x>Head <b>line</b></h1>", "<p>x</p>"]
    assert one(given, pages.page_title) == ["A & B", "Head line", None]
    long, short = "x" * 60, "y" * 20
    inside = f"<p>{long} out</p><article><p class='a'>{long}</p><p>{short}</p><p><i>{long}</i></p></article>"
    assert one([inside, f"<p>{long}</p>", f"<p>{long}</p><pre>no</pre><p>{long}</p>"], pages.page_body) == [
        f"{long}\n\n{long}", None, f"{long}\n\n{long}"]


def test_page_chrome(one):
    page = "\n".join([
        "Big news", "", "- [News](/n)", "# Big news", "![logo](logo.png)", "[Home](https://a.org)", "", "", "", "First line.",
        "![a](https://x.org/a.png) kept", "see [this](https://b.org/x) now", "a](http b](http c](http", "IDR 5",
        "[" + "w" * 60 + "](https://long.org)", "## Stay ahead in Asia", "after"])
    want = "# Big news\n\nFirst line.\n!a kept\nsee this now\n" + "w" * 60
    assert one([page, None, "", "### [💼 Latest Jobs]\nx"], pages.strip_page_chrome) == [want, "", "", ""]


def test_prefer_longer(spark):
    rows = [("a" * 100, "b" * 200), ("a" * 99, "b" * 200), ("a" * 99, "b" * 50), (None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "f string, s string")
    got = [r[0] for r in df.select(pages.prefer_longer(F.col("f"), F.col("s"))).collect()]
    assert got == ["a" * 100, "b" * 200, "a" * 99, "b", None]


def test_validation(spark):
    rows = [
        ("https://a.org", "x", "a@b.co", "2024-02-29", "https://c.org\n\n d.org"), ("a.org", " ", "bad", "2023-02-29", None),
        ("https://a.org", "x", None, "2024-1-5", ""),
    ]
    df = spark.createDataFrame(rows, "url string, page_title string, mail string, day string, links string")
    checked = validation.validate_rows(df, ["page_title"], email="mail", day="day", backlinks="links")
    assert [r["errors"] for r in checked.collect()] == [
        ["Line 3: Invalid URL format"],
        ["Page Title is required", "Invalid URL format", "Invalid email format", "Invalid date format"], []]
    good, bad = validation.split_accepted(checked)
    assert good.columns == df.columns and good.count() == 1 and bad.count() == 2


def test_tags(one):
    assert one(["a, b ,,c", "", None], validation.tags) == [["a", "b", "c"], [], []]
