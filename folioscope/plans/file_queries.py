"""Queries that write the given tables in the file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import shaping as S
from folioscope.plans.tables import CATALOGUE, catalogue, load
from folioscope.plans.tables import shared_folder as _folder
from folioscope.sources import files


def _a5(s, d):
    e = load(s, d, "events").select((F.col("user_id") % 2).alias("r"), (F.col("event_id") % 2).alias("c"), F.floor(F.col("event_id") / 1000).alias("piece"), F.struct(F.concat(F.lit("q"), "event_id").alias("id"), "value").alias("q"))
    runs = e.groupBy("r", "c", "piece").agg(F.to_json(F.struct(F.lit("x").alias("label"), F.lit("now").alias("at"), F.lit(1).alias("repeats"), F.collect_list("q").alias("per_question"))).alias("value"))
    root = _folder(s)
    for r, c in ((0, 0), (0, 1), (1, 0), (1, 1)):
        runs.where((F.col("r") == r) & (F.col("c") == c)).select("value").write.text(f"{root}/camp/r{r}/c{c}/r1.json")
    rows, _ = files.read_campaign(s, root, "id string, value double", lines=True)
    return rows.groupBy("rung", "condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


def _m4(s, d):
    p = load(s, d, "documents").select(F.concat(F.lit("a/"), "doc_id", F.element_at(F.array(F.lit(".TXT"), F.lit(".md"), F.lit(".bin")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("path"), F.encode("text", "UTF-8").alias("content"))
    pages, left = files.parse_by_extension(p, {"txt": files.text_pages, "md": files.text_pages})
    return pages.unionByName(left.select("path", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text")))


def _a6(s, d):
    e = load(s, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("r"), F.col("user_id") % 6).alias("rung"), F.col("value").alias("session_cost_usd"))
    path = _folder(s)
    e.select(F.to_json(F.struct("rung", "session_cost_usd")).alias("value")).unionByName(e.select(F.lit("").alias("value")).distinct()).write.text(path)
    return files.read_ledger(s, path).where("rung IS NOT NULL").groupBy("rung").agg(F.round(F.sum("session_cost_usd"), 4).alias("cost"))


def _a7(s, d):
    p = load(s, d, "pages")
    line = F.concat_ws("\t", F.concat(F.lit("p"), "page_id"), F.lit("ok"), F.length("html"), F.when(F.col("page_id") % 4 != 0, F.col("url")))
    path = _folder(s)
    p.select(line.alias("value")).write.text(path)
    return files.read_fetch_log(s, path)


def _a8(s, d):
    c = catalogue(s, d).select(F.col("source_path").alias("path"), F.concat(F.lit('a "quoted", title '), "id").alias("title"), F.col("page_count").alias("pages"), F.col("file_hash").alias("sha256"))
    path = _folder(s)
    files.write_manifest(c, path)
    return files.read_manifest(s, path).select("path", "title", "pages", "sha256")


def _a9(s, d):
    t = load(s, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("run"), F.col("turn") % 2).alias("run"), "turn", "text")
    path = _folder(s)
    files.write_transcripts(t, path)
    return files.transcript(s, path, "id string, turn long, text string, run string", "run1", "5").select("id", "turn", "text")


def _a1(s, d):
    """Files of some document digests each, accepted by their extension, and others of a kind that isn't wanted."""
    root, c = _folder(s), load(s, d, "documents").select((F.col("doc_id") % 50).alias("bucket"), "doc_id", F.concat_ws(" ", "doc_id", F.md5(F.coalesce("text", F.lit("")))).alias("value"))
    dealt = c.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    dealt.select("bucket", "value").write.partitionBy("bucket").text(f"{root}/Texts")
    dealt.where("bucket < 5").select("bucket", "value").write.partitionBy("bucket").json(f"{root}/other")
    good, bad = S.scan_files(s, root, (".txt", ".md"))
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket")
    return good.select(bucket, "length", "sha256").unionByName(bad.select(bucket, F.lit(None).cast("long").alias("length"), F.lit("rejected").alias("sha256")))


def _a13(s, d):
    """A report of two parts, written and read back."""
    c, path = load(s, d, "documents"), _folder(s)
    files.write_report({k: c.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")) for k in ("lang", "source")}, path)
    parts = [s.read.schema("key string, n long, chars long").json(f"{path}/{k}").withColumn("part", F.lit(k)) for k in ("lang", "source")]
    return parts[0].unionByName(parts[1])


QUERIES = {
    "a1_folder_scan": (
        _a1,
        """WITH t AS (SELECT doc_id % 50 AS bucket, string_agg(doc_id || ' ' || md5(coalesce(text, '')) || chr(10), '' ORDER BY doc_id) AS x FROM documents GROUP BY 1)
  SELECT bucket, cast(length(x) AS BIGINT) AS length, sha256(x) AS sha256 FROM t UNION ALL SELECT bucket, NULL, 'rejected' FROM t WHERE bucket < 5""",
    ),
    "a13_report": (_a13, "SELECT 'lang' AS part, lang AS key, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), sum(length(text))::BIGINT FROM documents GROUP BY source"),
    "a5_campaign_files": (_a5, "SELECT 'r' || user_id % 2 AS rung, 'c' || event_id % 2 AS condition, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    "a6_ledger": (_a6, "SELECT 'r' || user_id % 6 AS rung, round(sum(value), 4) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "a7_fetch_log": (_a7, "SELECT 'p' || page_id AS path, 'ok' AS status, cast(length(html) AS VARCHAR) AS size, url FROM pages WHERE page_id % 4 <> 0"),
    "a8_manifest_file": (_a8, f"SELECT source_path AS path, 'a \"quoted\", title ' || id AS title, page_count AS pages, file_hash AS sha256 FROM {CATALOGUE}"),
    "a9_transcripts": (_a9, "SELECT cast(conv_id AS VARCHAR) AS id, turn, text FROM conversations WHERE conv_id = 5 AND turn % 2 = 1"),
    "m4_parsed_files": (
        _m4,
        """SELECT path, CASE WHEN doc_id % 3 < 2 THEN page_number END AS page_number, CASE WHEN doc_id % 3 < 2 THEN pages[page_number] END AS text FROM (
        SELECT *, unnest(CASE WHEN doc_id % 3 < 2 THEN range(1, len(pages) + 1) ELSE [1] END) AS page_number FROM (
        SELECT doc_id, 'a/' || doc_id || ['.TXT', '.md', '.bin'][doc_id % 3 + 1] AS path, string_split(text, chr(12)) AS pages FROM documents))""",
    ),
}
