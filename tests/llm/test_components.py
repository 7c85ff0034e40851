"""Connected components against union-find, on chains, hubs and random graphs; findings by the ten thousand."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tests_llm_brute import roots_of

from pressgrid.llm import components as module
from pressgrid.llm.components import components
from pressgrid.llm.names import unused
from pressgrid.llm.secrets import find_secrets, redact_secrets
from pressgrid.operators import lookup


@pytest.mark.parametrize("small", [True, False])
def test_random_graphs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "HOT_ROWS", 5)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 999) for k in range(60)] + [(7, 7), (None, 3), (4, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    true = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == roots_of({n for link in true for n in link}, true)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    done = []
    keep = module._Tables.keep
    monkeypatch.setattr(module._Tables, "keep", lambda self, df: done.append(1) or keep(self, df))
    order = list(range(10_001))
    random.Random(3).shuffle(order)
    for path in (range(10_001), order):
        done.clear()
        rows = list(zip(path[:-1], path[1:]))
        got = components(spark.createDataFrame(rows, "a long, b long"))
        assert got.count() == 10_001 and got.filter("root <> 0").isEmpty()
        assert len(done) <= 60  # written tables: rounds and doublings together


def test_ten_thousands_of_findings_in_one_text(spark):
    n = 40_000
    text = "é ".join("%024x" % (k * 7919) for k in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    found = find_secrets(df).select(F.transform("base", lambda s: s["start"]).alias("at")).first()["at"]
    assert found == [26 * k for k in range(n)]
    assert redact_secrets(df).first()["text"] == "é ".join(["[hex]"] * n)
    assert time.time() - start < 120


def test_unused_names(spark):
    assert unused(spark.createDataFrame([], "a int, _a int, `_B` int"), "a", "_b", "c", "c") == ["__a", "__b", "c", "_c"]
