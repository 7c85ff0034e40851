"""Operators over small tables: ties, hot keys, brute-force comparisons, streams in several batches."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pressgrid import schemas
from pressgrid.functions.urls import match_url
from pressgrid.operators import dedupe, joins, lookup, mentions, ordering, quality, queue, transforms, views
from pressgrid.operators.dictionary import entries, joined_values, match_names
from pressgrid.operators.domains import impute_domains
from pressgrid.plans import enrich
from pressgrid.schemas import conform
from pressgrid.session import new_dir
from pressgrid.sources import files, tables
from pressgrid.streaming import jobs

T0 = dt.datetime(2025, 1, 31)


def as_of():
    return F.lit(T0)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


# ---- key joins


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # one key holds a third of the rows, some rows have none
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"))
    right = spark.range(0, 700, 2).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 10).alias("v")) \
        .unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    salted = lookup.salted_join(left, right, "k", how, hot_rows=100)
    assert rows(salted.select(*left.join(right, "k", how).columns)) == rows(left.join(right, "k", how))


def test_is_small(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 50).alias("t"))
    assert lookup.is_small(df, 100, 10_000)
    assert not lookup.is_small(df, 99, 10_000)
    assert not lookup.is_small(df, 100, 100)


# ---- numbering


def test_number_rows_over_partitions(spark):
    df = spark.range(10_000).select((10_000 - F.col("id")).alias("v")).repartition(13)
    got = ordering.number_rows(df, F.asc("v"), name="n", start=5)
    assert got.filter("n <> v + 4").count() == 0 and got.count() == 10_000


def test_rank_within_hot_and_null_keys(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * 37 % 11).alias("s"))
    got = ordering.rank_within(df, "k", F.desc("s"), F.asc("id"))
    df.createOrReplaceTempView("ranked_input")
    want = spark.sql("""SELECT id, row_number() OVER (PARTITION BY k ORDER BY s DESC, id) AS rank,
        count(*) OVER (PARTITION BY k) AS group_size FROM ranked_input""")
    assert rows(got, "id", "rank", "group_size") == rows(want, "id", "rank", "group_size")


def test_ids_of_an_empty_table(spark):
    table = conform(spark.createDataFrame([], "id long, url string"))
    new = spark.createDataFrame([(2, "b"), (1, "a")], "pos long, url string")
    assert rows(ordering.assign_ids(new, table, F.col("pos"), by=["pos"]), "url", "id") == [("a", 1), ("b", 2)]
    assert quality.max_id(table).first()[0] == 0


def test_missing_ids(spark):
    df = spark.createDataFrame([(7, "a", T0), (None, "c", T0), (None, "b", T0), (None, "z", None)], "id long, url string, updated_at timestamp")
    assert rows(ordering.fill_missing_ids(df), "url", "id") == [("a", 7), ("b", 9), ("c", 10), ("z", 8)]


# ---- repeated URLs


def dup(spark, *values):
    return conform(spark.createDataFrame(list(values), "id long, url string, title string, updated_at timestamp"))


def test_dedupe_ties_and_fresh_rows(spark):
    old, older, fresh = T0 - dt.timedelta(days=1), T0 - dt.timedelta(days=2), T0 - dt.timedelta(minutes=30)
    table = dup(
        spark, (1, "a", None, old), (2, "a", "t", older), (3, "a", None, fresh),  # fuller beats newer, fresh is held back
        (4, "b", "t", old), (5, "b", "t", old), (6, "b", "t", None),              # tie: smallest id, no time loses
        (7, "c", "t", fresh), (8, "c", None, old), (9, "d", None, None))
    kept = dedupe.dedupe_keep_best(table, as_of())
    assert [r[0] for r in rows(kept, "id")] == [2, 3, 4, 7, 9]
    ranked = dedupe.rank_duplicates(table)
    assert rows(ranked.filter("url = 'b'"), "id", "rank", "url_count") == [(4, 1, 3), (5, 2, 3), (6, 3, 3)]
    assert ranked.filter("url = 'd'").count() == 0


def test_dedupe_folds_exact_copies(spark):
    copies = dup(spark, *[(1, "a", "t", T0 - dt.timedelta(days=1))] * 50)
    assert dedupe.dedupe_keep_best(copies, as_of()).count() == 1


# ---- dictionaries


NAMES = ["acme", "acme labs", "b2b.io", "x", "new-co", "nn@h", "孵化器", "élan vital", "o'neil", "a.b\\E.c", "@tag", "lab"]
TEXTS = [
    "Acme raises", "at acme.", "acmes", "acme-labs and acme labs", "b2b.io!", "b2bxio", "x", "axb", "NEW-CO", "newco", "中孵化器在",
    "a孵化器", "9孵化器9", "xélan vitalé", "elan vital", "o'neil's", "a.b\\e.c", "say @tag", "say@tag", "acme\nlabs", "", None,
    "nn@h", "labélan vital",
]


def test_dictionary_forms_agree_with_brute_force(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    names = spark.createDataFrame([(n,) for n in NAMES + ["", "  "]], "name string")
    want = []
    for i, t in enumerate(TEXTS):
        padded = f" {(t or '').lower()} "
        hit = sorted({n for n in NAMES if re.search(f"[^a-z0-9]{re.escape(n.lower())}[^a-z0-9]", padded)}, key=lambda n: n.encode())
        want.append((i, ", ".join(hit) or None))
    for how, limit in (("inline", 10), ("join", 10), ("join", 0)):
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit * 1000)
        got = match_names(texts, entries(names, "name"), {"f": F.col("t")}, how)
        assert sorted(rows(got.select("i", joined_values("f", "name").alias("o")))) == want, how


def test_dictionary_join_keeps_duplicate_and_null_keys(spark):
    texts = spark.createDataFrame([(1, "acme"), (None, "acme labs"), (2, None)], "i int, t string")
    names = spark.createDataFrame([("acme",), ("labs",)], "name string")
    got = match_names(texts, entries(names, "name"), {"f": F.col("t")}, "join")
    assert rows(got.select("i", joined_values("f", "name"))) == [(1, "acme"), (2, None), (None, "acme, labs")]


def test_rows_that_share_a_key_keep_their_own_matches(spark):
    """Same url and id, other texts; and names without any a-z or 0-9."""
    data = [(1, "https://a.org/x", "acme grows"), (1, "https://a.org/x", "nothing here"), (1, "https://a.org/x", "東日本語 text"), (2, None, "日 本"), (3, None, "&&")]
    texts = spark.createDataFrame(data, "id int, url string, t string")
    for names in (["acme", "日本", "&&", "labs"], ["日本", "日 本", "語"]):
        table = spark.createDataFrame([(n,) for n in names], "name string")
        want = sorted((i, t, ", ".join(sorted(n for n in names if n in t)) or None) for i, _, t in data)
        for how in ("inline", "join"):
            got = match_names(texts, entries(table, "name"), {"f": F.col("t")}, how)
            assert sorted(map(tuple, got.select("id", "t", joined_values("f", "name")).collect())) == want, how


def test_repeated_updates_add_no_rows(spark):
    articles = schemas.conform(spark.createDataFrame([(1, "u1", "old"), (2, "u2", "old")], "id long, url string, content string"))
    edits = spark.createDataFrame([(1, "a", "p", "first", 1), (1, "b", "q", "last", 2), (None, "x", "y", "z", 3)],
                                  "id long, matched_portcos string, matched_spokespeople string, content string, seq int")
    got = transforms._put(articles, edits, "id", {"content": F.col("new_content")})
    assert sorted((r["id"], r["content"]) for r in got.collect()) == [(1, "last"), (2, "old")]


def test_counts_of_deleted_rows(spark):
    rows_ = [("https://a.org/x_1",)] * 1000 + [(None,)] * 1000 + [("https://a.org/y",), ("https://b.org/z1",)]
    articles = spark.createDataFrame(rows_, "url string")
    urls = spark.createDataFrame([("https://a.org/x_1",)], "url string")
    patterns = spark.createDataFrame([("https://a.org/...",)], "url string")
    assert transforms.count_deleted(articles, urls).first()[0] == 1000
    assert transforms.count_deleted_by_pattern(articles, patterns).first()[0] == 1001


def test_many_patterns_with_underscores(spark):
    articles = spark.range(300).select(F.concat(F.lit("https://a.org/x_"), "id", F.lit("/y")).alias("url"))
    patterns = spark.range(50, 10_050).select(F.concat(F.lit("https://a.org/x_"), "id", F.lit("/...")).alias("url"))
    assert transforms.delete_by_pattern(articles, patterns).count() == 50
    odd = spark.createDataFrame([("...org/x_7/...",), ("https://a.org/x_8...y",)], "url string")
    left = {r["url"] for r in transforms.delete_by_pattern(articles, odd).collect()}
    assert left == {f"https://a.org/x_{k}/y" for k in range(300) if k != 7 and k != 8 and not 80 <= k < 90}


def test_bodies_stay_out_of_the_duplicate_count(spark):
    from pressgrid.operators.dedupe import dedupe_keep_best
    table = schemas.conform(spark.createDataFrame([(1, "u1", "a"), (2, "u1", "b"), (3, "u2", "c"), (4, None, "d"), (5, None, "e")], "id long, url string, content string"))
    got = dedupe_keep_best(table, F.lit("2030-01-01").cast("timestamp"))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]


# ---- mentions


def test_partial_match_equals_pairwise_containment(spark):
    random.seed(5)
    hosts = ["https://a.org", "https://b.org"]
    parts = ["x", "xy", "x/y", "x/y/z", "news", "news/1", "news/12", "https://a.org/x", ""]
    pool = sorted({f"{h}/{p}".rstrip("/") for h in hosts for p in parts} | {f"{h}/{p}/{q}" for h in hosts for p in parts[:6] for q in "123"})
    articles = [(i + 1, u) for i, u in enumerate(random.sample(pool, 24))] + [(None, pool[0]), (90, pool[3]), (91, None)]
    counts = [(u, n + 1) for n, u in enumerate(random.sample(pool, 28))]
    adf = spark.createDataFrame(articles, "id long, url string")
    cdf = spark.createDataFrame(counts, "mention_url string, shares long")
    keys = {}
    for i, u in articles:
        if i is not None and u:
            norm = u.lower()
            keys[norm] = min(i, keys.get(norm, i))
    exact, partial = [], []
    for u, n in counts:
        if u in keys:
            exact.append((u, n, keys[u], u))
            continue
        hits = [(-min(len(u), len(a)), i, a) for a, i in keys.items() if a in u or u in a]
        if hits:
            _, i, a = min(hits)
            partial.append((u, n, i, a))
    assert rows(mentions.match_exact(cdf, adf), "mention_url", "shares", "id", "article_url") == sorted(exact)
    assert rows(mentions.match_partial(cdf, adf), "mention_url", "shares", "id", "article_url") == sorted(partial)
    assert exact and partial


def test_shares_add_up_over_mention_urls(spark):
    articles = spark.createDataFrame([(1, "https://a.org/x", 5), (2, "https://a.org/y", None), (None, "https://c.org", 1)],
                                     "id long, url string, social_shares_count long").withColumn("updated_at", as_of())
    matches = spark.createDataFrame([("u1", 2, 1), ("u2", 3, 1), ("u3", 4, 2)], "mention_url string, shares long, id long")
    assert rows(mentions.add_shares(articles, matches), "id", "social_shares_count") == [(1, 10), (2, 4), (None, 1)]


def test_mention_filters(spark):
    df = spark.createDataFrame([
        (1, "https://x.com/1", "founder", "", "n", ""), (2, "https://x.com/1", "founder with that", "", "n", ""),
        (3, "https://x.com/1", "founder", "", "Brand fan", ""), (4, "https://z.org", "founder", "", "n", ""),
        (5, "https://x.com/1", "nothing", None, None, None), (6, None, "founder", "", "", "")],
        "i int, url string, title string, summary string, author_name string, author_url string")
    kept = mentions.relevant_mentions(df, "Brand")
    assert [r[0] for r in rows(kept, "i")] == [1]  # 'hat' is inside 'that'
    assert [r[0] for r in rows(mentions.relevant_mentions(df, "Brand", match="word"), "i")] == [1, 2]
    assert [r[0] for r in df.select(match_url(F.col("url"))).distinct().collect()].count("") == 1


def test_pages_by_key_follow_pages_by_number(spark):
    table = spark.range(95).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("url"), F.when(
        F.col("id") < 60, F.lit(T0) - F.make_interval(hours=(F.col("id") / 3).cast("int"))).alias("updated_at"))
    last, seen = None, []
    for number in range(4):
        part = views.page_after(table, last, 25).collect()
        assert [r["url"] for r in part] == [r["url"] for r in views.page(table, number, 25).orderBy(
            F.desc_nulls_last("updated_at"), "url").collect()]
        seen += part
        last = (part[-1]["updated_at"], part[-1]["url"])
    assert len(seen) == 95


# ---- reports, dimension, transforms


def test_completeness_of_an_empty_table(spark):
    report = quality.completeness_report(conform(spark.createDataFrame([], "id long")))
    assert {(r["filled"], r["missing"], r["percent"]) for r in report.collect()} == {(0, 0, 0)} and report.count() == 21


def test_impute_without_profile(spark):
    media = spark.createDataFrame([(1, "www.k.org", 5, 0, 2, 3, "Tier 1"), (2, "l.org", 6, None, 2, 3, "Tier 1"), (3, "m.org", 8, 7, 0, None, None)],
                                  "id long, domain string, page_rank long, llm_rank long, hn_citation long, signal_score long, tier string")
    new = spark.createDataFrame([("K.org", 5), ("www.a.org", 5), ("b.org", 6), ("c.org", 7), ("d.org", None), ("e.org", 8)], "domain string, page_rank long")
    assert rows(impute_domains(new, media), "domain", "page_rank", "llm_rank", "hn_citation", "signal_score", "tier") == [
        ("a.org", 5, 5, 0, 5, "Tier 2"), ("b.org", 6, 5, 0, 5, "Tier 2"), ("c.org", 7, 5, 0, 5, "Tier 1"),
        ("d.org", 3, 5, 0, 5, "Tier 3"), ("e.org", 8, 7, 0, 5, "Tier 3")]


def test_domain_lookup_takes_smallest_id(spark):
    media = spark.createDataFrame([(2, "a.org", "X", 1, "t"), (1, "www.a.org", "Y", 2, "u")], "id long, domain string, country string, page_rank long, tier string")
    facts = spark.createDataFrame([(1, "www.A.org", None, None, ""), (2, None, None, None, None)],
                                  "id long, domain string, country string, page_rank long, tier string")
    assert rows(joins.domain_lookup(facts, media, ["id"]), "id", "country", "page_rank", "tier") == [(1, "Y", 2, ""), (2, None, None, None)]


def test_delete_by_pattern_forms(spark, monkeypatch):
    urls = ["https://a.org/xyz", "https://a.org/x", "https://a.org/a_b", "https://a.org/acb1", "https://b.org/q", None]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    patterns = spark.createDataFrame([("https://a.org/xy...",), ("https://a.org/a_b",), ("...b.org/...",), ("nothing...",)], "url string")
    want = [(1, "https://a.org/x"), (3, "https://a.org/acb1"), (5, None)]
    assert rows(transforms.delete_by_pattern(table, patterns)) == want
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert rows(transforms.delete_by_pattern(table, patterns)) == want


def test_queue_ids_are_stable_and_copies_collapse(spark):
    urls = spark.createDataFrame([(1, "a.org/x"), (2, "https://www.a.org/x/"), (3, "own.example/1"), (4, "k.org"), (5, None)], "pos long, url string")
    articles, log = spark.createDataFrame([("https://k.org",)], "url string"), spark.createDataFrame([], "url string")
    add = [queue.queue_add(urls, articles, log, "b", as_of(), "own.example") for _ in range(2)]
    assert rows(add[0], "id", "url") == rows(add[1], "id", "url") and [r["url"] for r in add[0].collect()] == ["https://a.org/x"]
    summary = quality.ingest_summary(queue.intake(urls, articles, log, "own.example")).first().asDict()
    assert summary == {"added": 1, "skipped_duplicates": 2, "skipped_own_site": 1, "total_input": 4}


def test_enrichment_keeps_earlier_matches_and_guard(spark):
    def words(kind, *values):
        return spark.createDataFrame(list(values), kind)
    d = enrich.Dictionaries(
        words("spokesperson_name string", ("Jo Doe",)), words("investor string, rank int", ("Cap", 3)), words("tagged_reporter string", ("Rep",)),
        words("portco_name string, portco_location string, portco_deal_lead string, ai string, vehicle string", ("Acme", "Oslo", None, "false", "F1")),
        words("id long, domain string, country string, page_rank long, tier string", (1, "a.org", "NO", 6, "T")))
    table = conform(spark.createDataFrame([
        (1, "https://www.a.org/1", "By Jo Doe", "Acme and jo doe met an incubator today", "old", "old lead", T0),
        (2, "https://a.org/2", None, "nothing of interest is in here", "old", "old lead", T0),
        (3, "https://a.org/3", None, "short Acme", "old", "old lead", T0), (4, "  ", "Brand", "Acme Acme Acme Acme Acme", None, None, T0)],
        "id long, url string, title string, content string, matched_portcos string, matched_portco_deal_lead string, updated_at timestamp"))
    for how in ("inline", "join"):
        out = {r["id"]: r for r in enrich.enrich_articles(table, d, "brand", as_of(), how=how).collect()}
        assert (out[1]["matched_portcos"], out[1]["matched_portco_deal_lead"], out[1]["matched_spokespeople"]) == ("Acme", None, "Jo Doe")
        assert out[1]["spokespeople_in_headline"] and out[1]["kill_pill"] and out[1]["kill_pill_count"] == 1 and out[1]["country"] == "NO"
        assert (out[2]["matched_portcos"], out[2]["matched_portco_deal_lead"], out[2]["tagged_portco"], out[2]["kill_pill"]) == ("old", "old lead", True, False)
        assert (out[3]["language"], out[3]["kill_pill"], out[3]["country"], out[3]["tagged_portco"]) == ("en", None, None, None)
        assert (out[4]["language"], out[4]["cleaned_url"], out[4]["brand_in_headline"]) == (None, None, None)


# ---- files


def test_delimited_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"url\n";Title;Date;Extra\n https://a.org ;"x; ""y""";NA;1\nhttps://b.org;"two\nlines";22 Sep 2025;2\n', encoding="utf-8")
    got = files.read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert [tuple(r)[1:] for r in got.orderBy("pos").collect()] == [
        ("https://a.org", 'x; "y"', None, None, None), ("https://b.org", "two\nlines", "22 Sep 2025", None, None)]
    (tmp_path / "b.csv").write_text("Headline,When\nx,y\n")
    with pytest.raises(ValueError, match="no url column"):
        files.read_delimited(spark, str(tmp_path / "b.csv"))


def test_missing_table_reads_empty(spark, tmp_path):
    assert tables.read_or_empty(spark, str(tmp_path / "none"), schemas.QUEUE).count() == 0


# ---- streams


def test_stream_dedupe_over_batches(spark, tmp_path):
    folder, out = tmp_path / "in", new_dir(spark, "dedupe")
    for n, part in enumerate([[(1, "a.org"), (2, "b.org"), (3, "a.org/")], [(4, "https://www.b.org"), (5, "c.org"), (6, "k.org")], [(7, "c.org"), (8, "d.org")]]):
        spark.createDataFrame(part, "pos long, url string").coalesce(1).write.mode("append").parquet(str(folder))
    known = spark.createDataFrame([("https://k.org",)], "url string")
    jobs.dedupe_query(jobs.read_stream(spark, str(folder), files=1), known, out).awaitTermination()
    got = jobs.stored(spark, out)
    assert sorted(r["url"] for r in got.collect()) == [f"https://{h}.org" for h in "abcd"]
    assert got.select("batch_id").distinct().count() >= 2
    # a restart reads nothing twice
    jobs.dedupe_query(jobs.read_stream(spark, str(folder), files=1), known, out).awaitTermination()
    assert jobs.stored(spark, out).count() == 4


def test_stream_state_and_counts_over_batches(spark, tmp_path):
    folder = tmp_path / "log"
    parts = [[("1", "pending", 1, 0), ("2", "pending", 2, 0)], [("1", "completed", 3, 5)], [("2", "failed", 4, 9), ("1", "pending", 0, 1)]]
    for part in parts:
        spark.createDataFrame([(i, "u", s, "b", q, T0 + dt.timedelta(minutes=m)) for i, s, q, m in part],
                              "id string, url string, status string, batch_name string, seq long, updated_at timestamp") \
            .coalesce(1).write.mode("append").parquet(str(folder))
    static = spark.read.parquet(str(folder))
    out = new_dir(spark, "state")
    jobs.queue_state_query(jobs.read_stream(spark, str(folder), files=1), out).awaitTermination()
    assert rows(jobs.queue_table(spark, out).read(), "id", "status") == rows(queue.latest_status(static), "id", "status")


def test_late_rows_are_left_out_and_open_hours_wait(spark, tmp_path):
    folder, out = tmp_path / "rows", new_dir(spark, "settled")
    for hours in ([0.1, 0.5, 1.2], [5.0], [0.2, 5.5, 9.0]):
        spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in hours], "updated_at timestamp").coalesce(1) \
            .write.mode("append").parquet(str(folder))
    jobs.settled_query(jobs.read_stream(spark, str(folder), files=1), out).awaitTermination()
    got = {int((r["hour_start"] - T0).total_seconds() // 3600): r["n"] for r in jobs.stored(spark, out).collect()}
    assert 9 not in got and got[1] == 1 and sum(got.values()) <= 6


# ---- plans


def test_default_plans_have_no_pairwise_join(spark):
    texts = spark.createDataFrame([(1, "acme")], "i int, t string")
    names = spark.createDataFrame([("acme",)], "name string")
    articles = spark.createDataFrame([(1, "https://a.org/x")], "id long, url string")
    counts = spark.createDataFrame([("https://a.org/x/1", 1)], "mention_url string, shares long")
    plans = [
        match_names(texts, entries(names, "name"), {"f": F.col("t")}, how) for how in ("inline", "join")
    ] + [mentions.match_partial(counts, articles), mentions.match_exact(counts, articles)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    inline = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in inline


def test_filters_and_columns_reach_the_scan(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = table.filter("doc_id = 5").select("doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "text" not in plan
