"""Tables that are kept: Parquet in buckets of documents that are merged in place, results that are worked out once, and a table's folder in versions.

Layout of a store: `bucket=k/part-*`. A change reads and rewrites the buckets of the documents that it touches; other buckets keep their files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.retrieval import small
from folioscope.plans.tables import stored

#: Rows of a store's file at most.
FILE_ROWS = 1_000_000


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file, as a sign that something is done."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


class BucketStore:
    """Rows that belong to documents (column owner), in so many buckets by a hash of it.

    A change is worked out and staged (by Spark's writer, beside the buckets) before the first bucket is replaced. If it fails in between, it is only run again: each of the changes
    gives the same rows when it is repeated. A document of many rows makes its bucket large, but not a task: buckets are written by several tasks where need be.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, owner: str = "doc_id", buckets: int = 64):
        self.spark, self.path, self.owner, self.buckets = spark, path.rstrip("/"), owner, buckets
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.owner).cast("string")), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All rows, with their bucket."""
        if not exists(self.spark, self.path):
            return self.empty.withColumn("bucket", F.lit(0))
        return self.spark.read.schema(self.empty.withColumn("bucket", F.lit(0)).schema).parquet(self.path)

    def _touched(self, wanted: DataFrame) -> list[int]:
        """Numbers of the buckets of wanted rows: as many as there are buckets at most."""
        return [r[0] for r in wanted.select(self.bucket().alias("b")).distinct().collect()]

    def count(self) -> int:
        return self.rows().count()

    def of(self, wanted: DataFrame) -> DataFrame:
        """All rows of wanted documents (owner); only their buckets are read."""
        return self.rows().where(F.col("bucket").isin(self._touched(wanted))).join(small(wanted.select(self.owner).distinct()), self.owner, "left_semi").select(*self.columns)

    def lookup(self, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """Rows whose keys are among wanted (owner and the other keys); only the buckets of wanted documents are read."""
        keys = [self.owner, *(k for k in keys if k != self.owner)]
        return self.rows().where(F.col("bucket").isin(self._touched(wanted))).join(wanted.select(*keys).distinct(), keys, "left_semi").select(*self.columns)

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Put rows, all that belong in the touched buckets, in the place of what is there."""
        rows = rows.select(*self.columns, self.bucket().alias("bucket"))
        full = {r[0] for r in rows.select("bucket").distinct().collect()}
        writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
        writer.option("compression", "zstd").partitionBy("bucket").parquet(self.path)
        for b in set(touched) - full:  # overwriting doesn't empty a bucket
            remove(self.spark, f"{self.path}/bucket={b}")

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        """Add rows, or put them in the place of those with the same owner and keys. Of new rows with equal keys one stays."""
        keys = [self.owner, *(k for k in keys if k != self.owner)]
        new = stored(new.select(*self.columns).dropDuplicates(keys))
        touched = self._touched(new)
        old = self.rows().where(F.col("bucket").isin(touched)).select(*self.columns)
        self._replace(new.unionByName(old.join(new.select(*keys), keys, "left_anti")), touched)

    def replace_owners(self, new: DataFrame, owners: DataFrame | None = None, written: bool = False) -> None:
        """Have exactly the new rows for each document that occurs in them or in owners, whose documents without new rows go. written: both are written tables, and owners
        has each of these documents once, so that they needn't be written here."""
        new = new.select(*self.columns)
        if written:
            gone = owners.select(self.owner)
        else:
            new = stored(new)
            gone = new.select(self.owner) if owners is None else new.select(self.owner).unionByName(owners.select(self.owner))
            gone = stored(gone.distinct())
        touched = self._touched(gone)
        old = self.rows().where(F.col("bucket").isin(touched)).select(*self.columns)
        self._replace(new.unionByName(old.join(small(gone), self.owner, "left_anti")), touched)

    def delete(self, owners: DataFrame) -> None:
        self.replace_owners(self.empty, owners)


def with_ids(chunks: DataFrame, *parts: str) -> DataFrame:
    """chunks whose blank chunk_ids are made from the named columns, so that a repeated run makes the same."""
    made = F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)
    return chunks.withColumn("chunk_id", F.when(F.trim(F.coalesce("chunk_id", F.lit(""))) == "", made).otherwise(F.col("chunk_id")))


def worked_out(inputs: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """work(inputs), whose rows (keys and schema's columns) are kept under path: inputs with keys that have results aren't worked on again.

    Each pair of keys is worked on once, however many inputs have it; work gives one row for each row that it is given.
    """
    spark = inputs.sparkSession
    known = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    missing = stored(inputs.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"))
    if not missing.isEmpty():
        work(missing).select(*known.columns).write.mode("append").parquet(path)
    return inputs.select(*keys).distinct().join(spark.read.schema(schema).parquet(path).dropDuplicates(keys), keys)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
