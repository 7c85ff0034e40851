"""Toxicity and language models: held-out accuracy and awkward tables."""

import numpy as np
from pyspark.sql import functions as F

from pressgrid.llm.language import count_grams, domain_of, host_of, page_languages
from pressgrid.llm.toxicity import fit, held_out, score_toxicity, threshold_of, train

FOLDER = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark, frame, awkward):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(~held_out()))
    scored = score_toxicity(docs, model).join(labels, "doc_id").filter(held_out()).select("rejected", "toxic").toPandas()
    assert (scored.rejected == (scored.toxic == 1)).mean() > 0.98
    assert (scored.rejected & (scored.toxic == 0)).mean() < 0.006  # some labels are wrong
    rows = score_toxicity(frame(awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["rejected"] for r in rows if not r["text"])
    assert rows[0]["token"] == "own token"
    assert score_toxicity(frame([]), model).count() == 0


def test_a_late_word_is_seen(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    clean = docs.join(labels.filter("toxic = 0 and quality = 1"), "doc_id").filter("lang = 'en'").orderBy("doc_id").first()["text"]
    long = " ".join([clean] * 20)
    rows = spark.createDataFrame([(1, long), (2, long + " stupid loser, worthless scum")], "doc_id long, text string")
    assert [r["rejected"] for r in score_toxicity(rows, model).orderBy("doc_id").collect()] == [False, True]


def test_no_model(spark, frame, awkward):
    docs = frame(awkward).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(10, 0), (11, 0), (11, 0), (None, 1), (12, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert model is None and fit([], [], np.zeros(0), []) is None
    assert {r["score"] for r in score_toxicity(docs, model).collect()} == {0.0}
    assert train(docs, labels.limit(0)) is None


def test_every_labelled_row_is_learned(spark):
    """A toxic word that only occurs in rows behind the first 3,000 of its class by hash, where the sample of old ended."""
    ids = [r["doc_id"] for r in spark.range(7000).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    rng = np.random.default_rng(1)
    plain = [f"word{k}" for k in range(200)]
    rows = []
    for place, doc_id in enumerate(ids):
        bad = ["" if place % 2 else "grubble" if place < 6200 else "snorkish"]
        rows.append((doc_id, " ".join([*rng.choice(plain, 12), *bad, *rng.choice(plain, 12)]), "xx", 1 - place % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    text = " ".join(plain[:20])
    asked = spark.createDataFrame([(1, text), (2, f"{text} grubble"), (3, f"{text} snorkish")], "doc_id long, text string")
    assert [r["rejected"] for r in score_toxicity(asked, model).orderBy("doc_id").collect()] == [False, True, True]


def test_shards_learn_as_well_and_alike(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(~held_out())
    model = train(docs, known, shard_rows=700)
    again = train(docs.repartition(7), known.repartition(3), shard_rows=700)
    assert (model.network.rows == again.network.rows).all() and (model.cut == again.cut).all()
    assert np.allclose(model.language_weights, train(docs, known).language_weights)  # counts of all rows, however dealt
    scored = score_toxicity(docs, model).join(labels, "doc_id").filter(held_out()).select("rejected", "toxic").toPandas()
    assert (scored.rejected == (scored.toxic == 1)).mean() > 0.98
    one_class = labels.filter("toxic = 0")
    assert train(docs, one_class, shard_rows=700) is None


def test_threshold():
    assert threshold_of(np.array([0.0, 1.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) == 2.0


def test_threshold_of_counted_rows():
    z, y, n = np.array([3.0, 0.0, 1.0]), np.array([9, 0, 2]), np.array([9, 5, 3])
    listed = [(a, k < b) for a, b, c in zip(z, y, n, strict=True) for k in range(c)]
    assert threshold_of(z, y, n) == threshold_of(*(np.array(v, float) for v in zip(*listed, strict=True))) == 0.5


def test_language(spark):
    docs, pages = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "pages"))
    names, shares = count_grams(docs)
    got = page_languages(pages, names, shares).join(pages, "page_id").withColumn("true", F.regexp_extract("url", "/(en|de|fr|es)/", 1)).toPandas()
    assert len(got) == pages.count()
    assert (got.lang == got.true).mean() > 0.99
    assert got.confidence.between(0, 1).all()

    html = pages.filter("url like '%/de/%'").first()["html"]
    rows = spark.createDataFrame([
        (1, None, None), (2, "", ""), (3, "no address", "<html lang='fr'>"), (None, "http://a.example.de/x", html), (4, "http://a.example.de/x", html),
        (4, "http://a.example.de/x", html), (5, "http://b.example.de/y", "<script>" + "the and of " * 50_000)], "page_id long, url string, html string")
    got = page_languages(rows.withColumns({"host": F.lit("own"), "log": F.lit("own")}), names, shares).collect()
    assert len(got) == 7 and all(r["lang"] in names for r in got)
    assert {r["lang"] for r in got if r["page_id"] in (None, 4)} == {"de"}
    assert page_languages(rows.limit(0), names, shares).count() == 0
    assert {r["lang"] for r in page_languages(rows, [], np.zeros((0, 1))).collect()} == {None}
    assert count_grams(docs.limit(0))[0] == []


def test_every_label_is_kept(spark):
    rng = np.random.default_rng(3)
    texts = {f"l{k:02}": " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)) for k in range(90)}
    docs = spark.createDataFrame([(t, x) for x, t in texts.items()] + [(t, x) for x, t in list(texts.items())[:40]], "text string, lang string")
    names, shares = count_grams(docs)
    assert names == sorted(texts) and np.allclose(np.exp(shares).sum(axis=1), 1, atol=1e-3)
    rows = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts.values())], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text_lang"], r["lang"]) for r in page_languages(rows, names, shares).collect()}
    assert got == {k: (x, x) for k, x in enumerate(texts)}


def test_every_ending_and_declared_value_counts(spark):
    """Values that are no label are told apart: .at and 'ger' go with de-at, .com and 'eng' with en."""
    en, de = "the house and the water with this other thing ", "das haus und wasser mit dieser anderen sache nicht "
    names, shares = count_grams(spark.createDataFrame([(en * 20, "en"), (de * 20, "de-at")], "text string, lang string"))
    rows = [(k, f"http://h{k}.com/", f"<html lang='eng'>{en}") for k in range(200)] + [
        (k, f"http://h{k}.at/", f"<html lang='ger'>{de}") for k in range(200, 260)]
    rows += [(900, "http://new.at/", None), (901, "http://new.com/", ""), (902, None, "<html lang='ger'>"), (903, None, "<html lang='eng'>")]
    got = {r["page_id"]: r["lang"] for r in page_languages(spark.createDataFrame(rows, "page_id long, url string, html string"), names, shares).collect()}
    assert [got[k] for k in (0, 200, 900, 901, 902, 903)] == ["en", "de-at", "de-at", "en", "de-at", "en"]


def test_hosts(one):
    assert one(["https://www.A.example.co.uk:80/x", "http://u@b.de", "x", None], lambda c: domain_of(host_of(c))) == ["example.co.uk", "b.de", "", ""]
