"""Streams in micro-batches that tests write one by one."""

import collections
import random

from pyspark.sql import functions as F

from folioscope.streaming import live

BASE = 1704067200  # 2024-01-01


def fed(spark, folder, schema, most=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).option("latestFirst", False).json(folder)


def put(spark, folder, rows, schema, n):
    """One file of rows; files are read in the order in which they are written."""
    import os
    import time

    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{folder}-{n}")
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in sorted(os.listdir(f"{folder}-{n}")) if f.endswith(".json"))
    os.rename(f"{folder}-{n}/{part}", f"{folder}/{n:03d}.json")
    stamp = time.time() - 1000 + n
    os.utime(f"{folder}/{n:03d}.json", (stamp, stamp))


def at(minutes):
    import datetime

    return datetime.datetime.fromtimestamp(BASE + minutes * 60, datetime.UTC).replace(tzinfo=None).isoformat(sep=" ")


def test_counters_equal_a_recount_after_every_micro_batch(spark, tmp_path):
    r, schema = random.Random(3), "document_id long, batch_id string, status string, ts timestamp"
    text = "document_id long, batch_id string, status string, ts string"
    batches = []
    for n in range(5):
        rows = [(r.randrange(12), "b1" if r.random() < 0.8 else "b2", r.choice(["pending", "parsing", "ready", "error"]), at(10 * n + r.randrange(25))) for _ in range(15)]
        batches.append(rows)
        put(spark, f"{tmp_path}/in", rows, text, n)
    live.status_changes(fed(spark, f"{tmp_path}/in", schema)).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).foreachBatch(
        lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
    ).start().awaitTermination()
    changes = spark.read.parquet(f"{tmp_path}/out")
    where = {}
    for n, rows in enumerate(batches):
        for d, b, s, t in sorted(rows, key=lambda x: (x[3], x[2])):
            if d not in where or t >= where[d][2]:
                where[d] = (b, s, t)
        sums = {(x.batch_id, x.status): x.c for x in changes.where(F.col("n") <= n).groupBy("batch_id", "status").agg(F.sum("change").alias("c")).where("c <> 0").collect()}
        assert sums == collections.Counter((b, s) for b, s, _ in where.values()), n


def test_a_late_score_is_joined_a_too_late_one_dropped_and_an_unmatched_trace_comes_once(spark, tmp_path):
    traces = [[(1, 0), (2, 1), (3, 2)], [(4, 100)], [(5, 300)], [(6, 600)]]
    scores = [[(1, 5, 0.9)], [(2, 55, 0.8), (9, 101, 0.1)], [(3, 290, 0.7)], [(4, 605, 0.6)]]
    for n in range(4):
        put(spark, f"{tmp_path}/t", [(i, at(m)) for i, m in traces[n]], "trace_id long, ts string", n)
        put(spark, f"{tmp_path}/s", [(i, at(m), c) for i, m, c in scores[n]], "trace_id long, ts string, confidence double", n)
    joined = live.late_scores(fed(spark, f"{tmp_path}/t", "trace_id long, ts timestamp"), fed(spark, f"{tmp_path}/s", "trace_id long, ts timestamp, confidence double"))
    got = collections.Counter((x.trace_id, x.confidence) for x in live.drained(joined, "append").collect())
    assert got == collections.Counter({(1, 0.9): 1, (2, 0.8): 1, (3, None): 1, (4, None): 1, (5, None): 1})  # 6 may still get a score


def test_idle_sessions_leave_the_state(spark, tmp_path):
    rows = [[(1, 0, 1), (1, 1, 2), (2, 3, 1)], [(1, 5, 3), (2, 900, 2)], [(3, 2000, 1)], [(3, 2001, 2)]]
    for n, batch in enumerate(rows):
        put(spark, f"{tmp_path}/in", [(k, at(m), t, 2) for k, m, t in batch], "key long, ts string, turn long, tokens long", n)
    memory = live.session_memory(fed(spark, f"{tmp_path}/in", "key long, ts timestamp, turn long, tokens long"), keep=2)
    got = [(x.key, list(x.last_turns), x.tokens, x.expired) for x in live.drained(memory, "update").collect()]
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, [
        (1, [1, 2], 4, False), (2, [1], 2, False), (1, [2, 3], 6, False), (2, [2], 2, False),  # session 2 was idle for over 12 hours
        (1, [2, 3], 6, True), (2, [2], 2, True), (3, [1], 2, False), (3, [1, 2], 4, False),
    ]))


def test_sessions_are_appended_when_they_are_over_and_late_turns_dropped(spark, tmp_path):
    rows = [[(1, 0, 5), (1, 30, 5)], [(1, 2000, 1)], [(1, 2010, 1)], [(1, 31, 100)], [(2, 4000, 1)]]
    for n, batch in enumerate(rows):
        put(spark, f"{tmp_path}/in", [(k, at(m), t) for k, m, t in batch], "key long, ts string, tokens long", n)
    sessions = live.session_activity(fed(spark, f"{tmp_path}/in", "key long, ts timestamp, tokens long"))
    got = sorted((x.key, x.turns, x.tokens) for x in live.drained(sessions, "append").collect())
    assert got == [(1, 2, 2), (1, 2, 10)]  # the turn of minute 31 came when its session was over; session 2 is not over


def test_feed_marks_duplicates_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    import os

    store, folder = f"{tmp_path}/store", f"{tmp_path}/files"
    os.makedirs(f"{folder}/sub")
    files = {"a.txt": "one", "b.txt": "two", "sub/c.txt": "one"}
    for n, (name, text) in enumerate(files.items()):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{folder}/{name}", (BASE + n, BASE + n))
    live.feed(live.file_stream(spark, folder, "*.txt"), "folder", store, f"{tmp_path}/p1")
    rows = live.documents_of(spark, store)
    first = {x.source_path: (x.status, x.duplicate_of is None) for x in rows.collect()}
    assert sorted(first) == ["a.txt", "b.txt", "sub/c.txt"] and first["b.txt"] == ("pending", True)
    assert sorted([first["a.txt"], first["sub/c.txt"]]) == [("pending", True), ("skipped_duplicate", False)]
    with open(f"{folder}/d.txt", "w") as f:
        f.write("two")
    with open(f"{folder}/e.txt", "w") as f:
        f.write("three")
    live.feed(live.file_stream(spark, folder, "*.txt"), "folder", store, f"{tmp_path}/p1")
    again = {x.source_path: x.status for x in live.documents_of(spark, store).collect()}
    assert len(again) == 5 and again["d.txt"] == "skipped_duplicate" and again["e.txt"] == "pending"
    kept = sorted(map(tuple, live.documents_of(spark, store).collect()), key=str)
    batch = live.documents_of(spark, store).where("batch = 1").select("id", "source_path", "hash")
    live.ingested("folder", store)(spark.createDataFrame(batch.collect(), batch.schema), 1)  # the batch is run again
    assert sorted(map(tuple, live.documents_of(spark, store).collect()), key=str) == kept
    live.feed(live.file_stream(spark, folder, "a.*"), "other", store, f"{tmp_path}/p2")
    assert live.documents_of(spark, store).where("feed = 'other'").first().status == "skipped_duplicate"
