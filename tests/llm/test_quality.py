"""The quality model: held-out accuracy, its parts against plain counterparts, awkward tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pressgrid.llm.quality import FEATURES, fit, measure, score_quality, train, tree_of_four, tree_of_three
from pressgrid.llm.toxicity import held_out

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark, frame, awkward):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter(~held_out()))
    scored = score_quality(docs, model).join(labels, "doc_id").filter(held_out()).select("accepted", "quality").toPandas()
    assert (scored.accepted == (scored.quality == 1)).mean() > 0.99
    rows = score_quality(frame(awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert len({r["quality_score"] for r in rows if not r["text"]}) == 1
    assert rows[0]["token"] == "own token" and rows[0]["score"] == "own score"
    assert score_quality(frame([]), model).count() == 0


def test_junk_at_the_end_of_a_long_text_is_seen(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    clean = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id").filter("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    rows = spark.createDataFrame([(1, clean), (2, clean + " spam" * 3000)], "doc_id long, text string")
    assert [r["accepted"] for r in score_quality(rows, model).orderBy("doc_id").collect()] == [True, False]


def test_few_labels(spark, frame, awkward):
    docs = frame(awkward)
    none = spark.createDataFrame([(None, 1), (12, None), (13, 7)], "doc_id long, quality int")
    assert {r["quality_score"] for r in score_quality(docs, train(docs, none)).collect()} == {0.5}
    one_class = spark.createDataFrame([(5, 1), (5, 1), (6, 1)], "doc_id long, quality int")
    assert {r["quality_score"] for r in score_quality(docs, train(docs, one_class)).collect()} == {0.75}
    both = spark.createDataFrame([(5, 1), (8, 0), (2, 0), (11, 1)], "doc_id long, quality int")
    first, again = (score_quality(docs, train(docs.repartition(k), both)).select("doc_id", "text", "quality_score") for k in (1, 4))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


def test_measures_do_not_depend_on_the_batch(awkward):
    texts = [t for _, t in awkward]
    whole = measure(pa.array(texts))
    for k, text in enumerate(texts):
        assert np.allclose(whole[k], measure(pa.array([text], pa.string()))[0]), (k, FEATURES)
    assert measure(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_measures_by_hand():
    got = dict(zip(FEATURES, measure(pa.array(["AB AB cd# 12\nÉÉ cd#"]))[0], strict=True))
    assert np.isclose(got["log_chars"], np.log1p(19)) and np.isclose(got["log_words"], np.log1p(6))
    assert np.isclose(got["upper"], 6 / 19) and np.isclose(got["digits"], 2 / 19) and np.isclose(got["symbols"], 2 / 19)
    assert np.isclose(got["distinct_words"], 4 / 6) and np.isclose(got["same_word"], 1 / 6) and np.isclose(got["top_word"], 2 / 6)
    assert np.isclose(got["upper_words"], 3 / 6) and np.isclose(got["marked_words"], 2 / 6) and np.isclose(got["log_lines"], np.log1p(2))


def test_trees_take_the_best_cut():
    g, h = np.array([1.0, 1, -3, -3, 5, 5]), np.ones(6)
    tree = tree_of_three(g, h)
    assert len(set(tree)) == 3 and tree[0] == tree[1] and tree[2] == tree[3] and tree[4] == tree[5]
    grid = np.zeros((4, 4))
    grid[:2, :2], grid[2:, 2:] = 3, 3
    grid[:2, 2:], grid[2:, :2] = -3, -3
    gain, cells = tree_of_four(grid, np.ones((4, 4)))
    assert gain > 0 and (np.sign(cells) == np.sign(grid)).all()


def test_pairs_catch_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y, np.ones(len(y)))
    fresh = rng.random((2000, 3))
    assert (0, 1) in model.pairs
    assert ((model.scores(fresh) >= 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.9
