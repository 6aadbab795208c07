"""Stores: merges that leave other buckets alone, pruned lookups, an index that follows changes, results that are worked out once."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import maintained, retrieval
from folioscope.sources import store


def files(path):
    return {b: {f.rpartition("/")[2] for f in glob.glob(f"{path}/bucket={b}/*.parquet")} for b in range(16) if glob.glob(f"{path}/bucket={b}/*.parquet")}


@pytest.fixture
def kept(spark, tmp_path):
    s = store.BucketStore(spark, f"{tmp_path}/chunks", "chunk_id string, doc_id long, text string", buckets=16)
    rows = spark.range(400).select(F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") / 10).cast("long").alias("doc_id"), F.lit("old").alias("text"))
    s.upsert(rows, ["chunk_id"])
    return s, rows


def test_upsert_and_delete_leave_other_buckets_alone(spark, kept):
    s, rows = kept
    before = files(s.path)
    assert s.count() == 400 and len(before) > 8
    new = spark.createDataFrame([("c30", 3, "new"), ("x", 3, "added"), ("x", 3, "added")], "chunk_id string, doc_id long, text string")
    s.upsert(new, ["chunk_id"])
    bucket = s.rows().where("doc_id = 3").select("bucket").distinct().collect()
    assert len(bucket) == 1
    after = files(s.path)
    assert {b for b in before if after[b] != before[b]} == {bucket[0][0]}
    assert sorted(r.text for r in s.rows().where("doc_id = 3").collect()) == ["added", "new"] + ["old"] * 9
    s.upsert(new, ["chunk_id"])  # a repeated run changes nothing
    assert s.count() == 401
    s.delete(spark.createDataFrame([(3,), (999,)], "doc_id long"))
    assert s.count() == 390 and s.rows().where("doc_id = 3").isEmpty()
    last = s.rows().where(F.col("bucket") == bucket[0][0]).select("doc_id").distinct()
    s.delete(last)  # a bucket of which nothing is left
    assert s.rows().where(F.col("bucket") == bucket[0][0]).isEmpty()


def test_lookups_read_their_buckets_alone(spark, kept):
    s, _ = kept
    wanted = spark.createDataFrame([(5, "c50"), (5, "c61"), (6, "c60")], "doc_id long, chunk_id string")
    found = s.lookup(wanted, ["chunk_id"])
    assert sorted(r.chunk_id for r in found.collect()) == ["c50", "c60"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    numbers = {r[0] for r in wanted.select(s.bucket()).distinct().collect()}
    assert "PartitionFilters: [bucket" in plan and len(numbers) <= 2
    assert len(found.inputFiles()) == sum(len(v) for v in files(s.path).values())  # of the whole table; what is scanned is pruned:
    scanned = s.rows().where(F.col("bucket").isin(list(numbers))).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in scanned} == numbers
    assert sorted(r.doc_id for r in s.of(spark.createDataFrame([(7,)], "doc_id long")).distinct().collect()) == [7] * 10


def test_an_empty_store(spark, tmp_path):
    s = store.BucketStore(spark, f"{tmp_path}/none", "chunk_id string, doc_id long")
    assert s.count() == 0 and s.lookup(spark.createDataFrame([(1, "c")], "doc_id long, chunk_id string"), ["chunk_id"]).count() == 0
    s.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert s.count() == 0


def test_blank_ids_are_made_alike_each_time(spark):
    rows = spark.createDataFrame([("", 1, "a"), (None, 1, "b"), ("own", 1, "a"), ("  ", 2, "a")], "chunk_id string, doc_id long, text string")
    once, twice = ([r.chunk_id for r in store.with_ids(rows, "doc_id", "text").collect()] for _ in range(2))
    assert once == twice and len(set(once)) == 4 and once[2] == "own"


def parts_of(index):
    return (
        sorted(map(tuple, index.postings.collect())), sorted((t, round(i, 9)) for t, i in index.terms.collect()), sorted((a, b, round(c, 9)) for a, b, c in index.lengths.collect()),
        round(index.average, 9), sorted((r.key, tuple(r.tokens)) for r in index.tokens.collect()),
    )


def test_index_follows_batches_as_a_rebuild_would_have_it(spark, tmp_path, monkeypatch):
    words, r = "pump valve seal motor shaft the of".split(), random.Random(4)
    index = maintained.MaintainedIndex(spark, f"{tmp_path}/index", buckets=8)
    now = {}
    schema = "chunk_id string, doc_id long, text string"
    for step in range(4):
        changed = {d: [(f"{d}:{i}", d, " ".join(r.choices(words, k=r.randrange(0, 8)))) for i in range(r.randrange(1, 4))] for d in r.sample(range(20), 8)}
        gone = [d for d in r.sample(range(20), 4) if d not in changed]
        chunks = spark.createDataFrame([x for v in changed.values() for x in v], schema)
        if step == 2:  # broken off between the preparation and the change of the tokens
            monkeypatch.setattr(store.BucketStore, "replace_owners", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                index.apply(chunks, spark.createDataFrame([(d,) for d in gone], "doc_id long"))
            monkeypatch.undo()
        else:
            index.apply(chunks, spark.createDataFrame([(d,) for d in gone], "doc_id long") if gone else None)
        now = {d: v for d, v in {**now, **changed}.items() if d not in gone}
        if step == 3:
            index.compact()
        again = retrieval.build_index(spark.createDataFrame([x for v in now.values() for x in v], schema))
        assert parts_of(maintained.MaintainedIndex(spark, f"{tmp_path}/index", buckets=8).index()) == parts_of(again), step
    index.apply(None, spark.createDataFrame([(d,) for d in range(20)], "doc_id long"))
    empty = index.index()
    assert empty.average == 0.0 and empty.postings.isEmpty() and empty.terms.isEmpty()


def test_results_are_worked_out_once(spark, tmp_path):
    given = []

    def work(rows):
        given.append(sorted(r.text for r in rows.collect()))
        return rows.select("sha", F.length("text").alias("n"))

    inputs = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("b", "yyy")], "sha string, text string")
    for part in (inputs.where("sha = 'a'"), inputs, inputs):
        found = store.worked_out(part, f"{tmp_path}/cache", ["sha"], work, "sha string, n int")
    assert given == [["xx"], ["yyy"]] and sorted(map(tuple, found.collect())) == [("a", 2), ("b", 3)]


def test_tokens_of_a_batch_are_not_copied_before_they_are_kept(spark, tmp_path, monkeypatch):
    copies, plain = [], store.stored
    for module in (store, maintained):
        monkeypatch.setattr(module, "stored", lambda df: copies.append(df.columns) or plain(df))
    index = maintained.MaintainedIndex(spark, f"{tmp_path}/index", buckets=4)
    rows = spark.range(300).selectExpr("concat('c', id) AS chunk_id", "id % 30 AS doc_id", "IF(id % 10 = 9, '', concat('pump x-', id, ' seal'))  AS text")
    index.apply(rows)
    index.apply(rows.where("doc_id % 3 = 0"), rows.where("doc_id = 1").select("doc_id"))
    assert not copies  # before: what is new, and all rows of the buckets that it touches
    assert not [f for what in ("new", "old") for f in glob.glob(f"{tmp_path}/index/{what}/*/*.parquet")]
    parts = parts_of(index.index())
    assert parts == parts_of(retrieval.build_index(rows.where("doc_id <> 1")))
    assert ((), ("pump", "x-3", "x", "3", "seal")) == tuple(next(t for k, t in parts[4] if k == key) for key in ("c9", "c3"))
