"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition makes one sorted run of distinct digests. In each binomial round a run meets the one whose number differs
in the round's bit: the two halve their digest ranges between their partitions, so that after round r a partition holds one of
2 ** r ranges of the merged run of 2 ** r inputs, and no partition grows. The exchange is by that partition's number; Spark's sort merges the
sorted pieces that arrive, and aggregation goes through them in order. A merged entry keeps the number of texts and the
best row so far. An entry is a digest *and* a second hash and the length of the normalised text: texts that agree in SHA-256
alone never meet, so that what is kept is verified at every level. A group of copies enters a round with one entry for each run at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import SPACES, joined_to_groups, own_columns, saved, table

_ENTRY = ["text_sha256", "check_hash", "norm_chars"]
#: Bits of a digest that can name its range.
_RANGE_BITS = 28


def numbered(docs: DataFrame) -> DataFrame:
    """docs as one column doc, and row: their numbers, given once, in a saved table."""
    return saved(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest columns and length of each row of docs (doc_id, text, row), with its run (input partition)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    return (
        docs.select("doc_id", "row", F.char_length(text).alias("chars"), bare.alias("bare"), F.spark_partition_id().alias("run"))
        .select("doc_id", "chars", "run", "row", F.sha2("bare", 256).alias("text_sha256"), F.xxhash64("bare").alias("check_hash"), F.char_length("bare").alias("norm_chars"))
    )


def merge_runs(rows: DataFrame, runs: int) -> DataFrame:
    """One entry for each distinct text: its digest columns, group_size and best row."""
    best = F.struct("chars", (-F.col("doc_id")).alias("back"), (-F.col("row")).alias("back_row"))
    level = rows.select("run", *_ENTRY, F.lit(1).cast("long").alias("group_size"), best.alias("best"))
    place = F.conv(F.substring("text_sha256", 1, _RANGE_BITS // 4), 16, 10).cast("long")
    rounds = max(0, runs - 1).bit_length()
    for r in range(rounds + 1):  # round 0 makes the runs themselves
        slot = F.shiftright("run", r) * (1 << r) + F.shiftright(place, _RANGE_BITS - r)
        level = (
            level.withColumn("slot", slot.cast("int"))
            .repartition(1 << rounds, "slot")
            .sortWithinPartitions("slot", *_ENTRY)
            .groupBy("slot", *_ENTRY)
            .agg(F.max("run").alias("run"), F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
        )
    return level.drop("run", "slot")


def _duplicates(docs: DataFrame) -> DataFrame:
    rows = saved(digest_rows(docs), "digests")
    top, total = rows.agg(F.max("run"), F.count(F.lit(1))).first()
    merged = saved(merge_runs(rows, 1 if top is None else top + 1), "merged")
    joined = joined_to_groups(rows, merged, _ENTRY, "group_size", total)
    return joined.select("doc_id", (-F.col("best.back")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.back_row")).alias("kept"), "text_sha256", "row")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, and empty
    texts are one group. Of a group the row with the most code points stays, then the smallest doc_id (null last), then the
    first in input order, so exactly one row of each group is kept even if a doc_id is repeated. An empty table gives no rows;
    other columns of docs are ignored.
    """
    return _duplicates(own_columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is the one that its group keeps, with all columns of docs, whatever their names.

    Null and empty texts are one group, of which a row stays; of repeated rows one stays; an empty table stays empty.
    """
    rows = numbered(docs)
    gone = _duplicates(rows.select("doc.doc_id", "doc.text", "row")).where("NOT kept").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT n, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)
"""

QUERIES = {"op10_exact_dedup": (op10_exact_dedup, ORACLE)}
