"""Campaign files, ledgers, fetch logs, manifests and transcripts: readers and writers of fixed schemas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document parser: files (path, content) to their pages (path, page_number, text).
Parser = Callable[[DataFrame], DataFrame]

#: A manifest's columns, in the order in which they are written.
MANIFEST = ("path", "category", "vendor", "product_family", "title", "pages", "size_bytes", "sha256", "source_url", "golden_questions")
LEDGER = "at string, rung string, condition string, session_cost_usd double, note string"
_COORDINATES = r"([^/]+)/([^/]+)/([^/]+)/r(\d+)\.json(?:/[^/]+)?$"


def read_campaign(spark: SparkSession, root: str, schema: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, manifests) of run files <campaign>/<rung>/<condition>/rN.json under root; side files of judges are left out.

    A run file has one JSON object with manifest fields and per_question, an array of records of the given schema. With lines, rN.json is a
    folder as Spark writes it, of files with an object a line, each with some of the run's records; manifests have a row for each object."""
    kind = f"label string, at string, repeats int, per_question array<struct<{schema}>>"
    files = spark.read.schema(kind).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*" if lines else "r*.json").json(root)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), _COORDINATES, k)
    runs = files.select("*", part(2).alias("rung"), part(3).alias("condition"), part(4).try_cast("int").alias("repeat")).where("repeat IS NOT NULL")
    keys = ["rung", "condition", "repeat"]
    return runs.select(*keys, F.explode("per_question").alias("q")).select(*keys, "q.*"), runs.select(*keys, "label", "at", "repeats")


def text_pages(files: DataFrame) -> DataFrame:
    """The parser of UTF-8 text: pages are parted by form feeds and numbered from 1; a file of null content has none."""
    cut = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("_at", "text"))
    return cut.select("path", (F.col("_at") + 1).alias("page_number"), "text")


def parse_by_extension(files: DataFrame, parsers: dict[str, Parser]) -> tuple[DataFrame, DataFrame]:
    """(pages, files without a parser) of files (path, content): each file goes to the parser of its extension, in lower case and
    without the dot. A null path, or one without extension, has the extension ''."""
    extension = F.lower(F.coalesce(F.regexp_extract("path", r"[^/\\]\.([^./\\]+)$", 1), F.lit("")))
    known = list(parsers)
    pages = [parse(files.where(extension == e)).select("path", "page_number", "text") for e, parse in parsers.items()]
    empty = files.where("false").select("path", F.lit(0).alias("page_number"), F.lit("").alias("text"))
    return reduce(DataFrame.unionByName, pages, empty), files.where(~extension.isin(known)).select("path")


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """A JSON-lines ledger; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, size, url) of a log of four tab-parted cells; other lines are dropped."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(cells) == 4)
    return rows.select(*[F.trim(F.get(cells, F.lit(k))).alias(n) for k, n in enumerate(("path", "status", "size", "url"))])


def write_manifest(rows: DataFrame, path: str) -> None:
    have = set(rows.columns)
    rows.select(*[F.col(c).cast("string") if c in have else F.lit("").alias(c) for c in MANIFEST]).write.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = ", ".join(f"{c} string" for c in MANIFEST)
    rows = spark.read.schema(text).option("header", True).csv(path)
    return rows.withColumn("pages", F.col("pages").try_cast("long")).withColumn("size_bytes", F.col("size_bytes").try_cast("long"))


def write_transcripts(rows: DataFrame, path: str, run: str = "run") -> None:
    """Gzipped JSON lines, a folder for each run."""
    rows.write.partitionBy(run).option("compression", "gzip").json(path)


def transcript(spark: SparkSession, path: str, schema: str, run: str, qid: str) -> DataFrame:
    """One question's transcript; only its run's folder is read."""
    return spark.read.schema(schema).json(path).where((F.col("run") == run) & (F.col("id") == qid))


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as a table of its own under path."""
    for name, df in parts.items():
        df.write.json(f"{path}/{name}")


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A small table as markdown; of a longer one the first rows, and how many there are."""
    found = df.limit(rows + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:rows]]
    return "\n".join(lines + ([f"more than {rows} rows"] if len(found) > rows else []))
