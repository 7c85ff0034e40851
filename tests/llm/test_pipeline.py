"""The pipeline against plain Python, stage by stage on what each stage before kept."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import brute_components, brute_pieces, lower


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage over a small set of documents with labels."""
    source = "/root/testdata/sf0.01"
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{source}/documents.parquet")
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "one two"), (9003, "one two"), (None, "nobody's text")], "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("extra").alias("source"), F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    docs.unionByName(extra.select(*docs.columns)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{source}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    out, rows = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, folder).write.parquet(f"{folder}/{name}")
        out[name] = (rows, spark.read.parquet(f"{folder}/{name}"))
        rows = out[name][1]
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema.simpleString() == before.schema.simpleString()
        if name in ("line_dedup", "secrets"):
            assert after.filter("n_chars <> coalesce(length(text), 0)").count() == 0


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = {r["doc_id"] for r in after.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = [r["doc_id"] for r in before.collect() if r["doc_id"] in truth]
    assert sum((d in left) == (truth[d] == 0) for d in known) >= 0.98 * len(known)
    assert {9001, 9002, 9003, None} <= left


def test_repeated_lines_go(stages):
    before, after = map(pairs, stages["line_dedup"])
    holders = {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for d, t in before:
        for line in (t or "").split("\n") if d is not None else ():
            holders.setdefault(key(line), set()).add(d)
    want = Counter((d, "\n".join(x for x in (t or "").split("\n") if d is None or len(key(x)) < 10 or min(holders[key(x)]) == d)) for d, t in before)
    assert Counter(after) == want


def test_near_duplicates_go(stages):
    before, after = map(pairs, stages["near_duplicates"])
    root = {d: c for d, _, c in brute_components(before, 5, 80)}
    assert Counter(after) == Counter(set((d, t) for d, t in before if d is not None and root[d] == d)) + Counter((d, t) for d, t in before if d is None)


def test_secrets_are_gone(stages):
    before, after = map(pairs, stages["secrets"])
    assert len(before) == len(after)
    clean = {d: t for d, t in before if not re.search("(?i)AKIA|[0-9a-f]{24}|password|passwd|secret|token|api_?key", t or "")}
    got = dict(after)
    assert all(got[d] == t for d, t in clean.items())
    assert not any(re.search(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}", t or "") for _, t in after)
    assert sum(t != got[d] for d, t in before) > 0


def test_packing(stages):
    before, after = stages["packing"]
    texts = Counter(hashlib.sha256(repr((d, ids)).encode()).hexdigest() for d, ids in brute_pieces(pairs(before)))
    got, open_ = Counter(), {}
    for p in sorted(after.collect(), key=lambda p: (p["sequence_id"], p["offset"])):
        own = open_.setdefault(p["doc_id"], [])
        own += p["ids"]
        if len(own) == p["doc_tokens"]:
            got[hashlib.sha256(repr((p["doc_id"], open_.pop(p["doc_id"]))).encode()).hexdigest()] += 1
    assert got == texts


def test_run(spark, tmp_path):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.agg(F.max("length")).first()[0] <= 1024
