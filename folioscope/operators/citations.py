"""Citations in recorded answers: markers, numbers, spans, realignment and the sources used.

answers: answer_id, text, sources (array of struct doc_id, page, text; in order, numbered from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

MARKER = r"\[Sources?\s+([\d,\s\-]+)\]"
#: Ranges that span more are malformed; quotes and compared text are cut there.
SPAN, QUOTE, COMPARED = 100, 500, 1500


def numbers(marker: Column) -> Column:
    """The numbers of a marker's list: ranges expanded, malformed, reversed and too wide ones dropped."""
    part = lambda x, k: F.regexp_extract(x, r"^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$", k).try_cast("int")
    one = lambda x: F.when(x.rlike(r"^\s*\d{1,9}\s*$"), F.array(X.trimmed(x).try_cast("int"))).when(
        (part(x, 1) <= part(x, 2)) & (part(x, 2) - part(x, 1) <= SPAN), F.sequence(part(x, 1), F.greatest(part(x, 1), part(x, 2)))
    ).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.split(marker, ","), one))


def segments(answers: DataFrame) -> DataFrame:
    """(answer_id, seg, text, cited): text before each marker with the marker's numbers; the last has none."""
    hits = F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))
    rows = answers.select("answer_id", F.posexplode(F.arrays_zip(F.split("text", MARKER, -1).alias("text"), hits.alias("marker"))).alias("seg", "x"))
    return rows.select("answer_id", "seg", "x.text", F.coalesce(numbers(F.col("x.marker")), F.array().cast("array<int>")).alias("cited"), F.col("x.marker").isNotNull().alias("marked"))


def valid_numbers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, seg, pos, number) of numbers within the sources, and (answer_id, dropped) with how many weren't."""
    sizes = answers.select("answer_id", F.size("sources").alias("n"))
    each = segments(answers).select("answer_id", "seg", F.posexplode("cited").alias("pos", "number")).join(sizes, "answer_id")
    inside = F.col("number").between(1, F.col("n"))
    return each.where(inside).drop("n"), each.groupBy("answer_id").agg(F.count_if(~inside).alias("dropped"))


def collapsed(answers: DataFrame) -> DataFrame:
    """(answer_id, seg, pos, number, citation): the first number seen for the same document and page."""
    found, _ = valid_numbers(answers)
    pages = answers.select("answer_id", F.posexplode("sources").alias("i", "s")).select("answer_id", (F.col("i") + 1).alias("number"), "s.doc_id", "s.page")
    w = Window.partitionBy("answer_id", "doc_id", "page").orderBy("seg", "pos")
    return found.join(pages, ["answer_id", "number"]).withColumn("citation", F.first("number").over(w)).select("answer_id", "seg", "pos", "number", "citation")


def spans(answers: DataFrame) -> DataFrame:
    """(answer_id, span, text, ids): text with the citations behind it; a marker without text before it adds to the span
    before, or makes an empty span at the start; text behind the last marker is a span without ids if not blank, as is an answer without markers."""
    ids = collapsed(answers).groupBy("answer_id", "seg").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "citation"))), lambda x: x["citation"])).alias("ids"))
    segs = segments(answers).join(ids, ["answer_id", "seg"], "left")
    w = Window.partitionBy("answer_id").orderBy("seg")
    solid = F.col("text").rlike(r"\S")
    rows = segs.withColumn("starts", solid | (F.col("seg") == 0)).withColumn("span", F.sum(F.col("starts").cast("int")).over(w) - 1)
    grouped = rows.groupBy("answer_id", "span").agg(F.max(F.when(F.col("starts"), F.col("text"))).alias("text"), F.array_sort(F.collect_list(F.struct("seg", "ids", "marked"))).alias("parts"))
    every = F.array_distinct(F.flatten(F.transform("parts", lambda x: F.coalesce(x["ids"], F.array().cast("array<int>")))))
    kept = F.col("text").rlike(r"\S") | F.exists("parts", lambda x: x["marked"]) | (F.col("span") == 0)
    return grouped.where(kept).select("answer_id", "span", "text", every.alias("ids"))


def realigned(rows: DataFrame, answers: DataFrame, least: float = 0.12, margin: float = 0.08) -> DataFrame:
    """spans with best: the source that shares most tokens (ties: the least number), if it has least and margin more than
    those cited; ids is then that one alone. Spans of under 20 characters or 3 tokens, or without ids, stay."""
    sources = answers.select("answer_id", F.posexplode("sources").alias("i", "s")).select("answer_id", (F.col("i") + 1).alias("number"), X.overlap_tokens(F.substring("s.text", 1, COMPARED)).alias("st"))
    cand = rows.where((F.size("ids") > 0) & (F.length(X.trimmed(F.col("text"))) >= 20)).select("answer_id", "span", "ids", X.overlap_tokens(F.col("text")).alias("t")).where(F.size("t") >= 3)
    scored = cand.join(sources, "answer_id").withColumn("score", X.overlap_score(F.col("t"), F.col("st")))
    best = scored.groupBy("answer_id", "span").agg(
        F.max(F.struct("score", -F.col("number"))).alias("top"), F.max(F.when(F.array_contains("ids", F.col("number")), F.col("score"))).alias("now")
    )
    better = (F.col("top.score") >= least) & (F.col("top.score") >= F.coalesce("now", F.lit(0.0)) + margin)
    moved = best.where(better).select("answer_id", "span", (-F.col("top.col2")).alias("best"))
    return rows.join(moved, ["answer_id", "span"], "left").withColumn("ids", F.when(F.col("best").isNotNull(), F.array("best")).otherwise(F.col("ids")))


def used_sources(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(answer_id, number, doc_id, page, quote) of the sources that spans still refer to."""
    ids = rows.select("answer_id", F.explode("ids").alias("number")).distinct()
    every = answers.select("answer_id", F.posexplode("sources").alias("i", "s")).select("answer_id", (F.col("i") + 1).alias("number"), "s.doc_id", "s.page", F.substring("s.text", 1, QUOTE).alias("quote"))
    return every.join(ids, ["answer_id", "number"])


def records(rows: DataFrame) -> DataFrame:
    """(answer_id, record): an answer's spans as JSON."""
    made = F.array_sort(F.collect_list(F.struct("span", "text", "ids")))
    return rows.groupBy("answer_id").agg(F.to_json(F.transform(made, lambda x: F.struct(x["text"].alias("text"), x["ids"].alias("ids")))).alias("record"))
