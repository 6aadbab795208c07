"""Live views of ingest and traces as Structured Streaming jobs. Every function takes and gives a (streaming) DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.plans.ship import ship
from folioscope.plans.tables import shared_folder, stored
from folioscope.sources.store import exists


def fresh_documents(files: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Files (ts, path, content hash) whose hash wasn't seen within the watermark, as pending documents."""
    return files.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["hash"]).withColumn("status", F.lit("pending"))


_FEED = "id string, source_path string, hash string, status string, duplicate_of string"


def documents_of(spark: SparkSession, store: str) -> DataFrame:
    """All that feeds have put into a store: id, source_path, hash, status, duplicate_of, feed, batch."""
    schema = f"{_FEED}, feed string, batch long"
    return spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)


def ingested(feed: str, store: str) -> Callable[[DataFrame, int], None]:
    """What a feed does with each micro-batch of files (id, source_path, hash): all become documents of the store, pending or, where
    an earlier file with another path has the same content, skipped_duplicate (of which document duplicate_of says).

    A path that comes again with other content is a new version and pending; with equal content it is skipped too. Of equal files of one batch the first by id counts. A batch
    is a folder of its own, which a repeated run overwrites, and isn't compared with itself.
    """

    def take(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        known = documents_of(spark, store).where((F.col("feed") != feed) | (F.col("batch") < batch)).where("status = 'pending'")
        known = stored(known.groupBy("hash").agg(F.min("id").alias("_known")))
        first = F.first("id").over(Window.partitionBy("hash").orderBy("id"))
        rows = files.select("id", "source_path", "hash").withColumn("_first", first).join(known, "hash", "left")
        same = F.coalesce("_known", F.when(F.col("_first") != F.col("id"), F.col("_first")))
        rows = rows.select("id", "source_path", "hash", F.when(same.isNull(), "pending").otherwise("skipped_duplicate").alias("status"), same.alias("duplicate_of"))
        rows.write.mode("overwrite").parquet(f"{store}/feed={feed}/batch={batch}")

    return take


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files of a folder as they come: id (by path), source_path (within the folder), hash of the bytes."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.sha2("path", 256).alias("id"), F.regexp_replace("path", F.lit("^.*?" + folder.split("//")[-1].strip("/") + "/"), F.lit("")).alias("source_path"), F.sha2("content", 256).alias("hash"))


def feed(files: DataFrame, name: str, store: str, progress: str) -> None:
    """Take all files that a stream has by now into a store; progress is the folder of its checkpoint."""
    files.writeStream.foreachBatch(ingested(name, store)).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def status_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _moved(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    out = []
    for row in pd.concat(list(batches)).sort_values(["ts", "status"]).itertuples():
        now = (row.batch_id, row.status, int(row.ts.value))
        if last is not None and now[2] < last[2]:
            continue
        if last is not None:
            out.append((last[0], last[1], -1))
        out.append((now[0], now[1], 1))
        last = now
    if last is not None:
        state.update(last)
    changes = pd.DataFrame(out, columns=["batch_id", "status", "change"]).groupby(["batch_id", "status"], as_index=False)["change"].sum()
    yield changes[changes["change"] != 0]


def status_changes(rows: DataFrame) -> DataFrame:
    """(batch_id, status, change) of rows (document_id, batch_id, status, ts): what each document's moves add to and take from the counters, so that sums of changes
    count each document once, where it is. A document's state is its last status; a row older than that is late and changes nothing."""
    ship(rows.sparkSession)
    kind, status = dict(rows.dtypes)["batch_id"], "status string"
    made = rows.select("document_id", "batch_id", "status", "ts").groupBy("document_id")
    return made.applyInPandasWithState(_moved, f"batch_id {kind}, {status}, change long", f"batch_id {kind}, {status}, at long", "append", GroupStateTimeout.NoTimeout)


def late_scores(traces: DataFrame, scores: DataFrame, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """traces (trace_id, ts, ...) with the confidence of scores (trace_id, ts, confidence) that comes within that time after them. A trace comes once: with
    its score, or without when the watermarks say that none can come any more; later scores are dropped."""
    left = traces.withWatermark("ts", watermark)
    right = scores.select(F.col("trace_id").alias("_id"), F.col("ts").alias("scored_at"), "confidence").withWatermark("scored_at", watermark)
    return left.join(right, F.expr(f"trace_id = _id AND scored_at >= ts AND scored_at <= ts + INTERVAL {within}"), "leftOuter").drop("_id")


def throughput(done: DataFrame, remaining: int, watermark: str = "10 minutes", span: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Rolling rate a minute and minutes left; null until a window has two samples."""
    g = done.withWatermark("ts", watermark).groupBy(F.window("ts", span, step)).agg(F.count(F.lit(1)).alias("n"))
    rate = F.when(F.col("n") >= 2, F.col("n") / (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")) * 60)
    return g.select(F.col("window.start").alias("start"), "n", rate.alias("per_minute"), (remaining / rate).alias("minutes_left"))


def session_activity(turns: DataFrame, gap: str = "12 hours", watermark: str = "1 hour") -> DataFrame:
    """Sessions (key, ts, tokens) that idle time parts, with their turns and tokens. In append mode a session comes when the watermark has passed its end;
    turns that are later than that are dropped."""
    g = turns.withWatermark("ts", watermark).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"))
    return g.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "tokens")


def _remembered(keep: int, idle: int):
    def remembered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, at = state.get if state.exists else ([], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "last_turns": [last], "tokens": [total], "expired": [True]})
            return
        for rows in batches:
            for row in rows.sort_values(["ts", "turn"]).itertuples():
                now = row.ts.value // 1_000_000
                if at and now - at >= idle:  # what was remembered is over
                    last, total = [], 0
                last, total, at = [*last, row.turn][-keep:], total + int(row.tokens), max(at, now)
        state.update((list(last), total, at))
        state.setTimeoutTimestamp(max(at + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "last_turns": [list(last)], "tokens": [total], "expired": [False]})

    return remembered


def session_memory(turns: DataFrame, keep: int = 5, idle_hours: int = 12, watermark: str = "1 hour") -> DataFrame:
    """Each session's last turns and token sum so far, as state by key; turns: key, ts, turn, tokens. A session that is idle so long by event time begins anew; when the watermark
    has passed that time its state is dropped, and a last row says expired."""
    ship(turns.sparkSession)
    made = turns.withWatermark("ts", watermark).groupBy("key")
    schema = "last_turns array<long>, tokens long"
    return made.applyInPandasWithState(_remembered(keep, idle_hours * 3_600_000), f"key long, {schema}, expired boolean", f"{schema}, at long", "update", GroupStateTimeout.EventTimeTimeout)


def stage_latency(traces: DataFrame, watermark: str = "1 hour", span: str = "1 hour") -> DataFrame:
    """Count, mean and approximate median of ms for each window and stage."""
    g = traces.withWatermark("ts", watermark).groupBy(F.window("ts", span), "stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.percentile_approx("ms", 0.5).alias("median"))
    return g.select(F.col("window.start").alias("start"), "stage", "n", "mean", "median")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when its sources are read to their end, from files in the shared store: appended rows, the last whole
    result (complete), or the rows of every update."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/appended").start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{'appended' if mode == 'append' else 'rows'}")
