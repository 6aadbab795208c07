"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own, fitted on a bounded sample; every row is indexed by its
pair of centroids. A query walks the centroid pairs by their summed squared distance with a heap until the pairs hold VISITED of the
distinct vectors, and their entries are reranked by the exact distance. Equal vectors are one entry with the ids that can rank, the
smallest K + 1, which loses nothing: all of them are equally near and ties go to smaller ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import mapped, own_columns, saved, table
from folioscope.plans.ship import ship

#: Rows that codebooks are fitted on at most, centroids of each half, and rounds of k-means.
FITTED, CENTROIDS, ROUNDS = 20_000, 64, 10
#: The share of the distinct vectors that a query's pairs hold (recall against brute force: README).
VISITED = 0.55
#: Index entries, and queries, that one group of reranking holds at most, or about.
BLOCK, ASKED = 4096, 2048


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids."""
        half = self.first.shape[1]
        return tuple((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1) for x, c in ((vectors[:, :half], self.first), (vectors[:, half:], self.second)))


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector has the most frequent length, only finite components and not only zeros."""
    v = F.col("embedding")
    fine = rows.where(v.isNotNull()).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists(v, lambda x: x != 0))
    top = fine.groupBy(F.size(v).alias("_size")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_size").limit(1)
    return fine.withColumn("_size", F.size(v)).join(F.broadcast(top.select("_size")), "_size").drop("_size")


def _celled(shared):
    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = shared.value.distances(_matrix(batch.column("embedding"))) if batch.num_rows else (np.zeros((0, 1)),) * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("entry", "embedding", "ids")), *(pa.array(x.argmin(1).astype(np.int32)) for x in d)], ["entry", "embedding", "ids", "c1", "c2"])

    return celled


def walked(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Centroid pairs by summed distance until they hold the wanted number of entries; sizes are the pairs' entries."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    heap, found = [(d1[o1[0]] + d2[o2[0]], 0, 0)], []
    while heap and wanted > 0:
        _, i, j = heapq.heappop(heap)
        n = int(sizes[o1[i], o2[j]])
        if n:
            found.append((o1[i], o2[j]))
            wanted -= n
        if j + 1 < len(o2):
            heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
    return found


def _probes(shared, visited: float):
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sizes = shared.value
        wanted = int(np.ceil(visited * sizes.sum()))
        for batch in batches:
            entries, vectors, c1, c2 = [], [], [], []
            if batch.num_rows:
                for k, (d1, d2) in enumerate(zip(*books.distances(_matrix(batch.column("embedding"))), strict=True)):
                    by_first: dict[int, list[int]] = {}
                    for a, b in walked(d1, d2, sizes, wanted):
                        by_first.setdefault(a, []).append(b)
                    for a, bs in by_first.items():
                        entries.append(k)
                        c1.append(a)
                        c2.append(bs)
            at = pa.array(entries, pa.int32())
            vectors = batch.column("embedding").take(at)
            yield pa.RecordBatch.from_arrays([batch.column("entry").take(at), vectors, pa.array(c1, pa.int32()), pa.array(c2, pa.list_(pa.int32()))], ["query", "vector", "c1", "seconds"])

    return probes


def _reranked(k: int):
    def reranked(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(entries):
            x, q = np.stack(entries["embedding"]).astype(np.float64), np.stack(queries["vector"]).astype(np.float64)
            c2, squares = entries["c2"].to_numpy(), (x**2).sum(1)
            ids = entries["entry"].to_numpy()
            allowed = np.zeros((len(queries), int(c2.max()) + 1), bool)
            for row, seconds in zip(allowed, queries["seconds"], strict=True):
                row[seconds[seconds < len(row)]] = True
            for a in range(0, len(q), 256):
                near = squares - 2 * q[a : a + 256] @ x.T
                near[~allowed[a : a + 256][:, c2]] = np.inf
                top = np.argpartition(near, k + 15, axis=1)[:, : k + 16] if near.shape[1] > k + 16 else np.tile(np.arange(near.shape[1]), (len(near), 1))
                for i, at in enumerate(top):
                    at = at[np.isfinite(near[i, at])]
                    d = np.sqrt(((x[at] - q[a + i]) ** 2).sum(1))
                    best = np.lexsort((ids[at], d))[:k]
                    out.append(pd.DataFrame({"query": queries["query"].iloc[a + i], "entry": ids[at[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return reranked


def search(rows: DataFrame, is_query, k: int = 10, visited: float = VISITED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest among the other rows (vec_id, embedding).

    is_query is a Column over vec_id. score is the Euclidean distance in double precision, ties go to smaller vec_ids; with
    fewer candidates than k all are returned. Vectors that are null or zero, or hold null or non-finite components, or have another
    length than most, take no part, neither do null vec_ids; a repeated vec_id counts once for each of its different vectors. An
    empty table gives no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    fine = saved(usable(own_columns(rows, "vec_id", "embedding").where("vec_id IS NOT NULL")).select("vec_id", "embedding").distinct(), "vectors")
    first = fine.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = saved(first.groupBy("embedding").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(FITTED).select("embedding").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = _matrix(sample.column("embedding"))
    half = max(1, fitted.shape[1] // 2)
    books = Codebooks(_k_means(fitted[:, :half], CENTROIDS), _k_means(fitted[:, half:], CENTROIDS) if fitted.shape[1] > half else np.zeros((1, 0)))
    index = saved(mapped(entries, _celled(spark.sparkContext.broadcast(books)), "entry long, embedding array<float>, ids array<long>, c1 int, c2 int"), "index")
    sizes = np.zeros((len(books.first), len(books.second)), np.int64)
    for a, b, n in index.groupBy("c1", "c2").agg(F.count(F.lit(1))).collect():  # CENTROIDS squared rows at most
        sizes[a, b] = n

    asked = fine.where(is_query)
    of_query = asked.join(entries.select("embedding", "entry"), "embedding").select("vec_id", "entry")
    of_query = saved(of_query, "queries")
    entries_asked = of_query.select("entry").distinct()
    parts = F.lit(-(-max(1, entries_asked.count()) // ASKED))
    probing = index.join(entries_asked, "entry", "left_semi").select("entry", "embedding")
    probes = mapped(probing, _probes(spark.sparkContext.broadcast((books, sizes)), visited), "query long, vector array<float>, c1 int, seconds array<int>")
    blocks = spark.createDataFrame([(a, max(1, -(-int(n) // BLOCK))) for a, n in enumerate(sizes.sum(axis=1))], "c1 int, blocks int")
    blocked = index.join(F.broadcast(blocks), "c1").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    spread = probes.join(F.broadcast(blocks), "c1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.pmod(F.xxhash64("query"), parts).cast("int"))
    ship(spark)
    near = spread.groupBy("c1", "block", "part").cogroup(blocked.select("c1", "block", "part", "entry", "embedding", "c2").groupBy("c1", "block", "part")).applyInPandas(_reranked(k + 1), "query long, entry long, score double")
    by_score = Window.partitionBy("query").orderBy("score", "entry")
    best = near.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    expanded = best.join(index.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy("score", "vec_id")
    tops = expanded.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("query", "score", "vec_id")
    answers = of_query.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(tops, "query").where("query_id <> vec_id")
    by_query = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_nearest": (op8_nearest, None)}
