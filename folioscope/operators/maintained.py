"""A BM25 index that is kept: document changes arrive as batches, and the index follows without reading texts that it has seen.

Stored are the tokens of chunks in buckets of documents (as one string of a chunk, since lists take more than twice the bytes in a shuffle), postings by generation (one for each batch), the documents that a generation replaces or
deletes, and each generation's document frequencies and totals, which are the last ones and the batch's difference. A posting is live if no
later generation replaces its document. compact() makes one generation of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.retrieval import Index, idf_of, postings_of, small
from folioscope.plans.tables import stored
from folioscope.sources.store import BucketStore, exists, mark, remove

_POSTINGS = "chunk_id string, doc_id long, term string, tf long"
_TOKENS = "key string, doc_id long, tokens string"


def _listed(rows: DataFrame) -> DataFrame:
    """rows with their tokens as lists again; no token has a space."""
    return rows.withColumn("tokens", F.when(F.col("tokens") == "", F.array().cast("array<string>")).otherwise(F.split("tokens", " ")))


class MaintainedIndex:
    """The index under path. apply() prepares a batch's generation, then changes the tokens, then marks it as done; a batch that was broken off when it was
    prepared is finished by the next call, one that wasn't has changed nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.tokens = BucketStore(spark, f"{self.path}/tokens", _TOKENS, buckets=buckets)

    def _last(self, what: str) -> int:
        """The last generation that is marked so; 0 if none is."""
        folder = f"{self.path}/{what}"
        if not exists(self.spark, folder):
            return 0
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [f.getPath().getName() for f in place.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(place)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def _read(self, what: str, schema: str, generation: int) -> DataFrame:
        path = f"{self.path}/{what}/{generation}"
        return self.spark.read.schema(schema).parquet(path) if generation and exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, what: str, generation: int) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{what}/{generation}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{what}/{generation}")

    def apply(self, chunks: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Documents that occur in chunks (chunk_id, doc_id, text) have exactly these chunks from now on; those of deleted (doc_id) none."""
        done = self.recover()
        g, none = done + 1, self.tokens.empty
        new = none if chunks is None else chunks.select(F.col("chunk_id").alias("key"), "doc_id", F.array_join(X.tokenise(F.col("text")), " ").alias("tokens"))
        new = self._write(new, "new", g)
        touched = new.select("doc_id") if deleted is None else new.select("doc_id").unionByName(deleted.select("doc_id"))
        touched = self._write(touched.distinct(), "touched", g)
        old = _listed(self._write(self.tokens.of(touched), "old", g))
        new = _listed(new)
        signed = new.select("tokens", F.lit(1).alias("sign")).unionByName(old.select("tokens", F.lit(-1).alias("sign")))
        change = signed.select(F.explode(F.array_distinct("tokens")).alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df"))
        df = self._read("df", "term string, df long", done).unionByName(change).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        self._write(df, "df", g)
        sums = signed.select(F.col("sign").cast("long").alias("n"), (F.col("sign") * F.size("tokens")).cast("long").alias("length"))
        totals = self._read("totals", "n long, length long", done).unionByName(sums).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        self._write(totals, "totals", g)
        postings = postings_of(new.select(F.col("key").alias("chunk_id"), "doc_id", "tokens"))
        self._write(postings.sortWithinPartitions("term"), "postings", g)  # in each file, where they are made
        mark(self.spark, f"{self.path}/prepared/{g}")
        self.recover()

    def recover(self) -> int:
        """Finish a prepared batch; the number of the last generation that is done."""
        done, g = self._last("done"), self._last("prepared")
        if g > done:
            self.tokens.replace_owners(self._read("new", _TOKENS, g), self._read("touched", "doc_id long", g), True)
            mark(self.spark, f"{self.path}/done/{g}")
            for what in ("new", "old"):  # only for this
                remove(self.spark, f"{self.path}/{what}/{g}")
        return max(done, g)

    def _generations(self, what: str, schema: str, first: int, last: int) -> DataFrame:
        rows = [self._read(what, schema, g).withColumn("generation", F.lit(g)) for g in range(first, last + 1)]
        out = self.spark.createDataFrame([], f"{schema}, generation int")
        for r in rows:
            out = out.unionByName(r)
        return out

    def postings(self) -> DataFrame:
        """Live postings: chunk_id, doc_id, term, tf."""
        last = self.recover()
        first = max(self._last("compacted"), 1)
        gone = self._generations("touched", "doc_id long", first + 1, last).groupBy("doc_id").agg(F.max("generation").alias("replaced"))
        live = self._generations("postings", _POSTINGS, first, last).join(small(gone), "doc_id", "left").where("replaced IS NULL OR generation >= replaced")
        return live.select("chunk_id", "doc_id", "term", "tf")

    def compact(self) -> None:
        """One generation of postings instead of all; nothing else changes."""
        last, live = self.recover(), stored(self.postings())
        if last > max(self._last("compacted"), 1):
            self._write(live.repartitionByRange("term").sortWithinPartitions("term"), "postings", last)
            mark(self.spark, f"{self.path}/compacted/{last}")

    def index(self) -> Index:
        """The index as it is now, as build_index() of all live chunks would make it."""
        last = self.recover()
        n, length = self._read("totals", "n long, length long", last).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        tokens = _listed(self.tokens.rows().select("key", "doc_id", "tokens"))
        average = length / n if n else 0.0
        lengths = tokens.select(F.col("key").alias("chunk_id"), F.size("tokens").alias("dl"), F.lit(average).alias("avgdl"))
        return Index(tokens, self.postings().select("chunk_id", "term", "tf"), idf_of(self._read("df", "term string, df long", last), F.lit(n)), lengths, average)
