"""Ranks, order statistics, digests and substring matches over ranges, against Python."""

import math
import random
import statistics

from pyspark.sql import functions as F

from folioscope.operators import graph, matching, order


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_go_on_over_the_ends_of_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([1, 2, 2, 2, None, 5]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {}
    for x in order.placed(df, ["g"], F.col("v"), F.col("i")).collect():
        got.setdefault(x.g, {})[x.place] = (x.v is not None, x.v or 0, x.i)
    for g in {x[0] for x in rows}:
        want = sorted((v is not None, v or 0, i) for k, v, i in rows if k == g)
        assert [got[g][n] for n in range(len(want))] == want
    whole = order.placed(df, [], F.col("i"))
    assert sorted((x.place, x.i) for x in whole.collect()) == [(i, i) for i in range(3000)]
    assert "windowspecdefinition(_part" in plan_of(whole)  # no window over all rows
    assert order.placed(df.where("false"), ["g"], F.col("v")).count() == 0


def test_order_statistics_equal_sorting(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 5 + ["a", "b"]), r.choice([None, 1.0, 1.0, r.random() * 9])) for _ in range(2500)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = {"low": 0.0, "median": 0.5, "p90": 0.9, "p95": 0.95, "high": 1.0}
    got = {x.g: x for x in order.order_statistics(df, ["g"], "v", shares, ("median", "p95")).collect()}
    assert set(got) == {"hot", "a", "b", "one"}
    for g, x in got.items():
        v = sorted(b for a, b in rows if a == g and b is not None)
        assert (x.low, x.high, x.p90) == (v[0], v[-1], v[int(0.9 * (len(v) - 1))])
        at = 0.95 * (len(v) - 1)
        assert math.isclose(x.median, statistics.median(v)) and math.isclose(x.p95, v[math.floor(at)] + (v[math.ceil(at)] - v[math.floor(at)]) * (at - math.floor(at)))


def test_a_digest_is_of_all_cells_in_any_order(spark):
    rows = [(f"q{i}", i, i % 3 == 0, None if i % 7 == 0 else i / 4) for i in range(200)] + [("q1", 1, False, 0.25)]
    schema = "id string, number int, answerable boolean, score double"
    df = spark.createDataFrame(rows, schema)
    digest = lambda x, leaf=4: order.table_digest(x, leaf).first()
    base = digest(df)
    assert base.rows == 201 and digest(df.orderBy(F.rand(3)).repartition(9).select("score", "answerable", "number", "id")) == base
    others = [
        df.distinct(), df.union(df.limit(1)), df.withColumnRenamed("score", "points"), df.withColumn("number", F.when(F.col("id") == "q150", -1).otherwise(F.col("number"))),
        df.withColumn("score", F.coalesce("score", F.lit(0.0))), df.where("id <> 'q77'"), df.withColumn("id", F.when(F.col("number") == 8, "q8 ").otherwise(F.col("id"))),
    ]
    found = [digest(x).digest for x in others]
    assert base.digest not in found and len(set(found)) == len(found)
    assert digest(df.where("false")).rows == 0 and digest(df.where("false")) == digest(df.where("number < 0").repartition(3))


def test_substrings_by_their_rarest_part(spark):
    r = random.Random(5)
    texts = [(i, "".join(r.choices("abcé 🙂", k=r.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, "the valve of the pump"), (502, "b" * 5000)]
    patterns = [(f"p{i}", "".join(r.choices("abcé 🙂", k=r.randrange(0, 6)))) for i in range(150)] + [("x", "valve"), ("x", "pump"), ("y", None), ("z", "zebra"), ("b", "bbb")]
    found = matching.contained(spark.createDataFrame(patterns, "id string, pattern string"), spark.createDataFrame(texts, "key long, text string"))
    want = {(i, k) for i, p in patterns if p for k, t in texts if t and p in t}
    assert [tuple(x) for x in found.collect()].__len__() == len(want) and {tuple(x) for x in found.collect()} == want
    queries = spark.createDataFrame([("q", "Is the VALVE open?"), ("r", None)], "query_id string, question string")
    matched = graph.match_by_name(queries, spark.createDataFrame([("e1", "valve"), ("e2", "Open"), ("e3", ""), ("e4", "close")], "id string, name string"))
    assert sorted(tuple(x) for x in matched.collect()) == [("q", "e1"), ("q", "e2")]
    assert "NestedLoop" not in matched._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan_of(matched)
