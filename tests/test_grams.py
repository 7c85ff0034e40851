"""Containment by rare runs against pairwise tests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import lookup, mentions, transforms
from pressgrid.operators.grams import contained


def likes(text, pattern):
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.replace("...", "%"))
    return re.fullmatch(body, text, re.S) is not None


@pytest.mark.parametrize("small", [True, False])
def test_contained_equals_pairwise(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "HOT_ROWS", 2)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé/") for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, "", "x" * 5000, "日本語のテキスト"]
    parts = [(k, "".join(rng.choice("abé/") for _ in range(rng.randrange(0, 12)))) for k in range(150)] + [(900, None), (901, "x" * 20), (902, "語の"), (903, "x" * 20)]
    got = contained(spark.createDataFrame([(t,) for t in texts * 2], "t string").repartition(4), "t",
                    spark.createDataFrame(parts, "k int, p string"), "p").select("t", "k").collect()
    want = {(t, k) for t in texts for k, p in parts if t is not None and p and p in t}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    assert contained(spark.createDataFrame([], "t string"), "t", spark.createDataFrame(parts, "k int, p string"), "p").count() == 0
    assert contained(spark.createDataFrame([("a",)], "t string"), "t", spark.createDataFrame([], "k int, p string"), "p").count() == 0


def test_ten_thousand_patterns_without_a_host(spark):
    articles = spark.range(2000).select(F.concat(F.lit("https://h"), F.col("id") % 40, F.lit(".org/p/"), "id", F.lit("/end")).alias("url"))
    loose = spark.range(500, 10_500).select(F.concat(F.lit("...org/p/"), "id", F.lit("/e...")).alias("url"))
    df = transforms.delete_by_pattern(articles, loose)
    assert df.count() == 500
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_forms_of_patterns(spark):
    rng = random.Random(7)
    urls = sorted({"".join(rng.choice(["a", "b", "_", "/", "\\", "%"]) for _ in range(rng.randrange(1, 9))) for _ in range(200)}) + [None, "", "https://x.org/abc_d"]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id int, url string")
    for patterns in (["a...b"], ["..."], ["__", "_"], ["___..."], ["..._b", "a/"], ["a_b...", "...\\..."], ["org/...", "...org/..._d", None], [], ["a%b", "", "b_..._a"]):
        left = transforms.delete_by_pattern(table, spark.createDataFrame([(p,) for p in patterns], "url string"))
        want = {u for u in urls if u is None or not any(likes(u, p) for p in patterns if p is not None)}
        assert {r["url"] for r in left.collect()} == want, patterns


def test_partial_matches_anywhere(spark):
    rng = random.Random(11)
    pool = sorted({"".join(rng.choice(["a.org", "/x", "/yz", "?u=", "b.org", "1"]) for _ in range(rng.randrange(1, 7))) for _ in range(260)})
    articles = [(k + 1, u) for k, u in enumerate(rng.sample(pool, 90))]
    counts = [(u, k + 1) for k, u in enumerate(rng.sample(pool, 120))]
    adf, cdf = spark.createDataFrame(articles, "id long, url string"), spark.createDataFrame(counts, "mention_url string, shares long")
    keys = {}
    for r in mentions.article_keys(adf).collect():
        keys[r["article_url"]] = min(r["id"], keys.get(r["article_url"], r["id"]))
    want = []
    for u, n in counts:
        if u not in keys:
            hits = [(-min(len(u), len(a)), i, a) for a, i in keys.items() if a in u or u in a]
            if hits:
                _, i, a = min(hits)
                want.append((u, n, i, a))
    got = mentions.match_partial(cdf, adf).select("mention_url", "shares", "id", "article_url").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10
    assert any(not (u.startswith(a) or a.startswith(u)) for u, _, _, a in want)
    with pytest.raises(ValueError):
        mentions.match_partial(cdf, adf, mode="other")
