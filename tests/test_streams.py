"""Streams over several batches: bounded state, late rows, tables folded from a log, repeated batches."""

import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from pressgrid.operators import queue
from pressgrid.session import new_dir
from pressgrid.streaming import jobs
from pressgrid.streaming.folded import FoldedTable

T0 = dt.datetime(2024, 6, 1)


def local(path):
    return path.removeprefix("file:")


def test_dedupe_reads_no_earlier_output(spark, tmp_path):
    """Three batches; what a batch wrote is moved away before the next one runs, and the table of known URLs grows meanwhile."""
    folder, out, known = str(tmp_path / "in"), new_dir(spark, "dedupe"), str(tmp_path / "known")
    spark.createDataFrame([("https://k.org",)], "url string").write.parquet(known)
    batches = [
        [(k, "hot.org" if k % 3 else f"u{k}.org") for k in range(60)], [(100, "u3.org"), (101, "https://www.hot.org/"), (102, "new.org"), (99, "new.org"), (103, None)],
        [(200, "new.org"), (201, "k.org"), (202, "late-known.org"), (203, "last.org")]]
    got = []
    for n, part in enumerate(batches):
        spark.createDataFrame(part, "pos long, url string").repartition(3).write.mode("append").parquet(folder)
        if n == 2:
            spark.createDataFrame([("https://late-known.org",)], "url string").write.mode("append").parquet(known)
        query = jobs.dedupe_query(jobs.read_stream(spark, folder), lambda: spark.read.parquet(known), out)
        query.awaitTermination()
        found = [(r["url"], r["pos"]) for r in jobs.stored(spark, out).collect()]
        got.append(sorted(found))
        shutil.rmtree(local(out) + "/rows")
    assert got[0] == sorted([("https://hot.org", 1)] + [(f"https://u{k}.org", k) for k in range(0, 60, 3)])
    assert got[1:] == [[("https://new.org", 99)], [("https://last.org", 203)]]


def test_dedupe_state_is_let_go(spark, tmp_path):
    folder, out = str(tmp_path / "in"), new_dir(spark, "dedupe")
    known = spark.createDataFrame([], "url string")
    held = []
    for day in range(6):
        rows = [(day * 100 + k, f"d{day}-{k}.org", T0 + dt.timedelta(days=day * 10)) for k in range(20)]
        spark.createDataFrame(rows, "pos long, url string, at timestamp").coalesce(1).write.mode("append").parquet(folder)
        query = jobs.dedupe_query(jobs.read_stream(spark, folder), known, out, horizon="7 days", arrived="at")
        query.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    assert jobs.stored(spark, out).count() == 120
    assert held[2] == max(held) == held[-1] == 3 * held[0], held  # from the third batch on as many go as come


def hours_of(rows):
    return {int((r["hour_start"] - T0).total_seconds() // 3600): r["n"] for r in rows}


def test_settled_and_late_rows_are_all_rows_of_closed_hours(spark, tmp_path):
    folder, out = str(tmp_path / "rows"), new_dir(spark, "guard")
    rng = random.Random(4)
    sent = []
    for batch in range(4):
        hours = [rng.uniform(0, 4 * (batch + 1)) for _ in range(40)]
        sent += hours
        rows = [(h, T0 + dt.timedelta(hours=h)) for h in hours] + [(-1.0, None)]
        spark.createDataFrame(rows, "h double, updated_at timestamp").repartition(2).write.mode("append").parquet(folder)
        jobs.late_guard_query(jobs.read_stream(spark, folder), out).awaitTermination()
    settled = hours_of(jobs.settled_hours(spark, out).collect())
    late = jobs.late_rows(spark, out)
    closed = max(sent) - 1.5
    # by hand: an hour is closed for a batch by the rows of the batches before it
    want_late = [h for n in range(4) for h in sent[40 * n : 40 * n + 40] if n and int(h) + 1 <= max(sent[: 40 * n]) - 1.5]
    assert sorted(r["h"] for r in late.collect()) == sorted(want_late + [-1.0] * 4) and want_late
    all_closed = {h: sum(int(x) == h for x in sent) for h in {int(x) for x in sent} if h + 1 <= closed}
    counted = dict(settled)
    for h in want_late:
        counted[int(h)] = counted.get(int(h), 0) + 1
    assert counted == all_closed
    assert jobs.retry_late(spark, out) == len(want_late) and jobs.retry_late(spark, out) == 0
    assert hours_of(jobs.settled_hours(spark, out).collect()) == all_closed


def test_late_guard_on_empty_input(spark, tmp_path):
    folder, out = str(tmp_path / "rows"), new_dir(spark, "guard")
    for rows in ([], [(T0,)], []):
        spark.createDataFrame(rows, "updated_at timestamp").coalesce(1).write.mode("append").parquet(folder)
        jobs.late_guard_query(jobs.read_stream(spark, folder), out).awaitTermination()
    assert jobs.settled_hours(spark, out).count() == 0 and jobs.late_rows(spark, out).count() == 0


EVENT = "id string, url string, status string, batch_name string, seq long, updated_at timestamp"


def test_fifty_batches_read_no_more_files_than_ten(spark, tmp_path):
    rng = random.Random(9)
    table = jobs.queue_table(spark, str(tmp_path), buckets=4, fold_every=5)
    events, files = [], []
    for batch in range(50):
        part = [(str(rng.randrange(40)), "u", rng.choice(["pending", "completed"]), "b", batch * 3 + k, T0 + dt.timedelta(minutes=rng.randrange(5000))) for k in range(3)]
        events += part
        table.add(spark.createDataFrame(part, EVENT).coalesce(1), batch)
        files.append(len(table.read().inputFiles()))
    assert max(files[10:]) <= max(files[:10]) + 4 and files[-1] <= 4 + 5
    want = queue.latest_status(spark.createDataFrame(events, EVENT))
    assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    table.add(spark.createDataFrame(part, EVENT), 49)  # a batch that is run again
    table.fold(49)
    assert sorted(map(str, table.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_sums_are_not_doubled_by_repeated_batches_and_folds(spark, tmp_path):
    table = FoldedTable(spark, str(tmp_path), "k", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), buckets=3, fold_every=3)
    for batch in range(8):
        part = spark.createDataFrame([("hot", 1)] * 20 + [(f"k{batch % 3}", 1), (None, 1)], "k string, n long")
        for _ in range(1 + batch % 2):
            table.add(part, batch)
        if batch == 5:
            table.fold(5)
    got = {r["k"]: r["n"] for r in table.read().collect()}
    assert got == {"hot": 160, None: 8, "k0": 3, "k1": 3, "k2": 2}


def test_share_counts_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), new_dir(spark, "shares")
    articles = spark.createDataFrame([(1, "https://www.a.org/x"), (2, "https://b.org/y")], "id long, url string")
    schema = "url string, title string, summary string, author_name string, author_url string"
    for n in range(3):
        rows = [("https://x.com/1", "founder", f"see https://a.org/x and https://c.org/{n}", "u", "v")] * (n + 1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.share_count_query(jobs.read_stream(spark, folder), "thble", out).awaitTermination()
    assert [(r["id"], r["shares"]) for r in jobs.article_shares(spark, out, articles).collect()] == [(1, 6)]
    assert jobs.share_table(spark, out).read().count() == 4


def test_a_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = spark.range(10).withColumn("t", F.lit("x"))
    rows.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for table in ("many.parquet", "one.parquet"):
        out = new_dir(spark, "table")
        seen = []
        query = jobs.read_stream(spark, str(tmp_path), table).writeStream.foreachBatch(
            lambda batch, _: seen.extend(r["id"] for r in batch.collect())).option("checkpointLocation", f"{out}/state")
        query.trigger(availableNow=True).start().awaitTermination()
        assert sorted(seen) == list(range(10)), table
