"""Tables of the document collection, derived from the star schema and the text tables, in Spark and as SQL.

SQL holds the same derivations as text, for the oracles.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is not set on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        shared = _FALLBACK[0]
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared store and read back, for what several branches of a query need."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """stored(), in buckets of the first column, as many as a shuffle has partitions: joins and groups by that column don't shuffle it again."""
    spark, key = df.sparkSession, df.columns[0]
    name, buckets = f"dealt_{uuid.uuid4().hex}", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document catalogue: ten documents make the versions of a path, twenty batches; every ninth is still in work."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"), i.alias("n"), F.concat_ws("/", F.concat(F.lit("b"), i % 20), "lang", "source", F.concat(F.lit("doc_"), i, F.lit(".txt"))).alias("filename"),
        F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), i, F.lit(".txt"))).alias("source_path"), F.concat_ws("/", "lang", F.concat(F.lit("family_"), i % 10)).alias("family"),
        F.sha2("text", 256).alias("file_hash"), F.lit("txt").alias("file_type"), F.ceil(F.char_length("text") / 2000).cast("long").alias("page_count"), F.ceil(F.char_length("text") / 500).cast("long").alias("chunk_count"),
        F.when(i % 9 == 8, F.when(i % 2 == 0, "processing").otherwise("error")).otherwise("ready").alias("status"), F.when(i % 9 == 8, F.get(F.array(*map(F.lit, ("parsing", "chunking", "embedding"))), ((i / 9).cast("int") % 3))).alias("stage"),
        F.concat(F.lit("b"), i % 20).alias("batch_id"), F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("upload_date"), (i / 10).cast("long").alias("version"), "lang", "source",
    )


CATALOGUE = """(SELECT cast(doc_id AS VARCHAR) AS id, doc_id AS n, 'b' || doc_id % 20 || '/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS filename,
  lang || '/' || source || '/doc_' || doc_id || '.txt' AS source_path, lang || '/family_' || doc_id % 10 AS family, sha256(text) AS file_hash, 'txt' AS file_type,
  cast(ceil(length(text) / 2000) AS BIGINT) AS page_count, cast(ceil(length(text) / 500) AS BIGINT) AS chunk_count,
  CASE WHEN doc_id % 9 = 8 THEN CASE WHEN doc_id % 2 = 0 THEN 'processing' ELSE 'error' END ELSE 'ready' END AS status,
  CASE WHEN doc_id % 9 = 8 THEN ['parsing', 'chunking', 'embedding'][doc_id // 9 % 3 + 1] END AS stage,
  'b' || doc_id % 20 AS batch_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS upload_date, doc_id // 10 AS version, lang, source FROM documents)"""


def pages(spark: SparkSession, sf_dir: str, size: int = 2000) -> DataFrame:
    """Pages of a fixed number of code points."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(F.char_length("text") > 0)
    n = F.ceil(F.char_length("text") / size).cast("int")
    return d.select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(1), n)).alias("page_number")).select(
        "doc_id", "lang", "page_number", F.substring("text", (F.col("page_number") - 1) * size + 1, F.lit(size)).alias("text")
    )


PAGES = """(SELECT doc_id, lang, cast(p AS INTEGER) AS page_number, substr(text, (p - 1) * 2000 + 1, 2000) AS text
  FROM (SELECT doc_id, lang, text, unnest(range(1, cast(ceil(length(text) / 2000) AS BIGINT) + 1)) AS p FROM documents WHERE length(text) > 0))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each solid line of a document; lines with cells are table rows, every seventh other one is a step."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    row, step = F.contains("line", F.lit(" | ")), F.col("chunk_index") % 7 == 3
    marked = F.when(row, F.concat(F.lit("| "), "line", F.lit(" |"))).when(step, F.concat(F.lit("Step "), "chunk_index", F.lit(" "), "line")).otherwise(F.col("line"))
    d = d.where(F.col("line").rlike("[^ \t]")).withColumn("text", marked).drop("line")
    return d.where(F.col("text").rlike("[^ \t]")).select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", "lang", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


CHUNKS = r"""(SELECT doc_id || ':' || (i - 1) AS chunk_id, doc_id, lang, i - 1 AS chunk_index, CASE WHEN contains(x[i], ' | ') THEN '| ' || x[i] || ' |' WHEN i % 7 = 4 THEN 'Step ' || (i - 1) || ' ' || x[i] ELSE x[i] END AS text
  FROM (SELECT doc_id, lang, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(x[i], '[^ \t]'))"""
