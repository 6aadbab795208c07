"""Interaction of document filters by failing-id relations.

Documents are read once; each filter then has a stored table of the ids (row numbers) of the documents that fail it. Rows that fail
none survive everything and are only counted. What a sequence of filters leaves depends on the *set* of those applied, so every other
row stands once for each set, and a set's survivors are what left-anti joins with the tables of its filters leave; a left-semi join of
them with the next filter's table is what that one removes. The tables are bucketed and sorted by id alike, so that none of these joins
shuffles, and ids are row numbers, so that no text, source or doc_id, however common, makes a bucket large.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import bucketed, joined_to_groups, own_columns, saved, scratch, table

_SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a bucket of the id tables, roughly.
BUCKET_ROWS = 1_000_000


def contract_filters(text: Column) -> dict[str, Column]:
    """Filters that look at one text: true where it fails."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters=contract_filters, repeats: str = "E") -> DataFrame:
    """(row, part, doc_id, and a boolean for each filter) of docs (doc_id, text, source): the filters of a text, and one that fails texts
    that a smaller doc_id has too.

    A null text or source is empty; a null doc_id comes after all others, and repeated rows are rows of their own, none of which repeats the other.
    Texts are equal if their SHA-256, xxhash64 and length are.
    """
    text = F.coalesce("text", F.lit(""))
    key = ["digest", "check_hash", "n"]
    rows = own_columns(docs, "doc_id", "text", "source").withColumn("text", text)
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("source", F.lit("")).alias("part"), "doc_id", *[c.alias(k) for k, c in filters(F.col("text")).items()],
        F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("check_hash"), F.char_length("text").alias("n"),
    )
    rows = saved(rows, "filtered")
    total = rows.count()
    groups = rows.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first_id IS NOT NULL")
    groups = saved(groups, "copies")
    later = joined_to_groups(rows.select("row", "doc_id", *key), groups, key, "copies", total).where("doc_id IS NULL OR doc_id > first_id").select("row", F.lit(True).alias(repeats))
    return rows.drop(*key).join(later, "row", "left").withColumn(repeats, F.coalesce(repeats, F.lit(False)))


def id_tables(failed: DataFrame, names: list[str], rows: int) -> dict[str, DataFrame]:
    """A table of the rows that fail it for each filter, and under "" one of the rows (row, part, good, toxic) that fail any."""
    made, buckets = {}, max(failed.sparkSession.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    for name in ["", *names]:
        own = failed.where(F.col(name) if name else F.greatest(*names)).select("row", *([] if name else ["part", "good", "toxic"]))
        made[name] = bucketed(own, f"failing_{name or 'any'}", buckets, "row")
    return made


def interactions(failed: DataFrame, names: list[str]) -> DataFrame:
    """(part, set, filter, survivors, removed, good_lost, toxic_lost): per set of filters (bit i: names[i]) the rows of a part that
    survive it (filter null), and per further filter what that removes of them; only counts above 0.

    failed: row, part, good, toxic and a boolean for each of names. Rows that fail no filter are in no count.
    """
    spark = failed.sparkSession
    with scratch(spark):
        tables = id_tables(failed, names, failed.count())
        left = tables[""].select("row", "part", "good", "toxic", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("set"))
        gone = {n: tables[n].select(F.col("row").alias("_row")).hint("shuffle_hash") for n in names}  # a bucket of ids is held at a time
        for i, name in enumerate(names):
            left = left.join(gone[name], (F.col("row") == F.col("_row")) & (F.col("set").bitwiseAND(1 << i) > 0), "left_anti")
        counts = [F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good_lost"), F.sum(F.col("toxic").cast("long")).alias("toxic_lost")]
        found = left.groupBy("part", "set").agg(*counts).select("part", "set", F.lit(None).cast("int").alias("filter"), "n", "good_lost", "toxic_lost")
        for i, name in enumerate(names):
            lost = left.where(F.col("set").bitwiseAND(1 << i) == 0).join(gone[name], F.col("row") == F.col("_row"), "left_semi")
            found = found.unionByName(lost.groupBy("part", "set").agg(*counts).withColumn("filter", F.lit(i)))
        return saved(found, "interactions", beyond=True)


def audit(docs: DataFrame, labels: DataFrame, filters=contract_filters, repeats: str = "E", names: str = "ABCDE") -> DataFrame:
    """Per part (source; null: empty), order of all filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. Every part of docs has all rows; an empty table gives none.

    labels (doc_id, quality, toxic): a document is good (toxic) if any label of its doc_id says so; null doc_ids have no label. Odd rows of docs as in failures().
    """
    marks = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    failed = failures(docs, filters, repeats)
    known = failed.where("doc_id IS NOT NULL").join(marks, "doc_id").select("row", "good", "toxic")
    failed = failed.drop("doc_id").join(known, "row", "left").fillna(False, ["good", "toxic"])
    failed = saved(failed, "failed")
    parts = failed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(*names).cast("long")).alias("failing"))
    return _orders(parts, interactions(failed, list(names)), names)


def _orders(parts: DataFrame, found: DataFrame, names: str) -> DataFrame:
    n, zero = len(names), F.lit(0).cast("long")
    whole = (1 << n) - 1
    pairs = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((whole + 1) * n - 1))).alias("pair"))
    pairs = pairs.select("part", (F.col("pair") / n).cast("int").alias("set"), (F.col("pair") % n).alias("filter")).where("shiftright(set, filter) % 2 = 0")
    measured = ["removed", "good_lost", "toxic_lost"]
    steps = pairs.join(found.where("filter IS NOT NULL").withColumnRenamed("n", "removed"), ["part", "set", "filter"], "left").fillna(0, measured)
    left = found.where("filter IS NULL").select("part", F.col("set").alias("after"), F.col("n").alias("left"))
    steps = steps.withColumn("after", F.expr("set + shiftleft(1, filter)")).join(left, ["part", "after"], "left").join(parts, "part")
    steps = steps.withColumn("kept", F.col("rows") - F.col("failing") + F.coalesce("left", zero))
    # a set of k filters goes before one filter in k! (n - 1 - k)! orders
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("set") + 1)
    alone = F.expr("set + shiftleft(1, filter)") == whole
    sums = steps.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("set") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).cast("long").alias("shapley")
    )
    rows = [("".join(names[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    walks = parts.sparkSession.createDataFrame(rows, "filter_order string, step int, set int, filter int")  # n * n! rows
    out = steps.join(sums, ["part", "filter"]).join(F.broadcast(walks), ["set", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
b AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(w.t, '[^A-Z]+', '', 'g')) > 2 * length(w.t),
    regexp_matches(w.t, '[#$%&*|]'), doc_id > first_id] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN g USING (t) LEFT JOIN b USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS p FROM i p JOIN i q ON q.i <> p.i JOIN i r ON r.i NOT IN (p.i, q.i) JOIN i s ON s.i NOT IN (p.i, q.i, r.i) JOIN i u ON u.i NOT IN (p.i, q.i, r.i, s.i)),
m AS (
  SELECT part, p, i AS step, p[i] AS filter, fails[p[i]] AS bad, list_bool_or(list_prepend(false, list_transform(p[:i - 1], lambda x: fails[x]))) AS before,
    list_sum(list_transform(fails, lambda x: x::INT)) AS total, n, good, toxic
  FROM c, o, i
), s AS (
  SELECT part, list_aggregate(list_transform(p, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, step, filter,
    sum(CASE WHEN NOT bad AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bad AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND total = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bad AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM s
"""

QUERIES = {"op13_filter_audit": (op13_filter_audit, ORACLE)}
