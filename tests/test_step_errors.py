"""A step that fails for one row: logged, passed over, and the row's other columns still filled."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressgrid.functions import text
from pressgrid.plans import enrich
from pressgrid.schemas import conform

T0 = dt.datetime(2024, 6, 1)
BODY = "acme and jane doe met about the elk in a long enough text"


def dictionaries(spark):
    return enrich.Dictionaries(
        people=spark.createDataFrame([("jane doe",)], "spokesperson_name string"), investors=spark.createDataFrame([], "investor string, rank int"),
        reporters=spark.createDataFrame([], "tagged_reporter string"),
        companies=spark.createDataFrame([("acme", "Berlin", "lead", "false", "Fund 1")], "portco_name string, portco_location string, portco_deal_lead string, ai string, vehicle string"),
        media=spark.createDataFrame([(1, "a.org", "DE", 5, "Tier 1")], "id long, domain string, country string, page_rank long, tier string"))


def run(spark, rows, **options):
    table = conform(spark.createDataFrame(rows, "id long, url string, content string, domain string, kill_pill boolean").withColumn("updated_at", F.lit(T0)))
    done = enrich.enrich_with_errors(table, dictionaries(spark), "thble", F.lit(T0), kill_pill=["elk"], assign_missing_ids=False, **options)
    log = enrich.enrichment_log(done, F.lit("r"), F.lit(T0), F.lit(T0)).collect()
    steps = {}
    for r in log:
        steps.setdefault(r["url"], []).append((r["step"], r["severity"]))
    return {r["url"]: r for r in done.collect()}, steps, log


def test_a_row_that_fails_in_keywords(spark):
    fails = {"KEYWORDS": F.when(F.col("url").endswith("/bad"), F.concat(F.lit("cannot read "), "url"))}
    rows, steps, log = run(spark, [(1, "https://a.org/good", BODY, "a.org", None), (2, "https://a.org/bad", BODY, "a.org", False)], fails=fails)
    good, bad = rows["https://a.org/good"], rows["https://a.org/bad"]
    assert (good["kill_pill"], bad["kill_pill"], bad["kill_pill_count"]) == (True, False, None)
    for c in ("matched_spokespeople", "matched_portcos", "country", "tier", "month", "tagged_portco"):
        assert good[c] == bad[c] and good[c] is not None
    assert ("KEYWORDS", "ERROR") in steps["https://a.org/bad"] and ("DONE", "INFO") in steps["https://a.org/bad"]
    assert ("KEYWORDS", "INFO") in steps["https://a.org/good"] and len(steps["https://a.org/good"]) == len(steps["https://a.org/bad"])
    assert [r["message"] for r in log if r["severity"] == "ERROR"] == ["cannot read https://a.org/bad"]


def test_steps_that_end_a_row(spark):
    fails = {"GUARD_CONTENT": F.when(F.col("url").endswith("/guard"), "stopped"), "MEDIA_META": F.when(F.lit(True), "no dimension")}
    rows, steps, _ = run(spark, [
        (1, "", BODY, "a.org", None), (None, "https://a.org/noid", BODY, "a.org", None), (3, "https://a.org/guard", BODY, "a.org", None),
        (4, "https://a.org/short", "x", "a.org", None), (5, "https://a.org/x", BODY, "a.org", None)], fails=fails)
    assert steps[""] == [("START", "INFO"), ("SELECT", "ERROR")] and rows[""]["month"] is None
    assert steps["https://a.org/noid"] == [("START", "INFO"), ("ASSIGN_ID", "ERROR")]
    assert steps["https://a.org/guard"][-1] == ("GUARD_CONTENT", "ERROR") and rows["https://a.org/guard"]["matched_portcos"] is None
    assert rows["https://a.org/guard"]["month"] is not None  # normalisation comes before
    assert steps["https://a.org/short"][-1] == ("SKIP", "WARN")
    assert steps["https://a.org/x"][-2:] == [("MEDIA_META", "ERROR"), ("DONE", "INFO")] and rows["https://a.org/x"]["country"] is None


def test_text_that_is_no_utf8(spark):
    table = spark.createDataFrame([(1, "https://a.org/1", "a.org")], "id long, url string, domain string").withColumns(
        {"content": F.concat(F.lit(BODY), F.expr("CAST(X'C328' AS STRING)")), "updated_at": F.lit(T0), "matched_portcos": F.lit("old")})
    done = enrich.enrich_with_errors(conform(table), dictionaries(spark), "thble", F.lit(T0), assign_missing_ids=False)
    r = done.select("country", "matched_portcos", "kill_pill", F.col("step_errors.step").alias("steps")).first()
    assert (r["country"], r["matched_portcos"], r["kill_pill"]) == ("DE", "old", None)
    assert r["steps"] == ["NORMALIZE", "ENRICH_SPOKES", "ENRICH_INVESTORS", "ENRICH_REPORTERS", "ENRICH_PORTCOS", "KEYWORDS"]


def test_unknown_steps_are_refused(spark):
    with pytest.raises(ValueError):
        enrich.step_failures({"NOTHING": F.lit("x")})
    assert text.GUARD_LENGTH == 20
