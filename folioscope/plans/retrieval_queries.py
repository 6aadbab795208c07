"""Retrieval queries: benchmark items and embeddings as queries, document lines and embeddings as corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from folioscope.operators import retrieval as R
from folioscope.operators.maintained import MaintainedIndex
from folioscope.operators.scoring import Scope, dense_top_k, excluded_documents, sparse_scores, sparse_top_k, unit
from folioscope.plans.ship import ship
from folioscope.plans.tables import CHUNKS, chunks, load, shared_folder, stored

_KEPT: dict[tuple[str, str, str], object] = {}


def _once(spark, d, what, made):
    """What is built once for an application, then read from the shared store."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _KEPT:
        _KEPT[key] = made()
    return _KEPT[key]


def _questions(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _chunks(spark, d):
    return _once(spark, d, "chunks", lambda: stored(chunks(spark, d)))


def _index(spark, d):
    return _once(spark, d, "index", lambda: R.build_index(_chunks(spark, d), stored))


def _vectors(spark, d):
    """Unit vectors of the chunks. The embedder is a count of some letters, so that the oracle can have the same vectors."""
    return _once(spark, d, "vectors", lambda: stored(unit(_chunks(spark, d).select(F.col("chunk_id").alias("key"), "doc_id", "text").transform(_lettered))))


def _scores(spark, d):
    i = _index(spark, d)
    return sparse_scores(_questions(spark, d), i.tokens, i.terms, i.average).select("query_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"))


_TOK = r"""flatten(list_transform(regexp_extract_all(translate(regexp_replace(lower({c}), '<[^>]*>', ' ', 'g'), '*_|', '   '), '[a-z0-9][a-z0-9\-./]*[a-z0-9]|[a-z0-9]'),
  lambda x: CASE WHEN regexp_matches(x, '[-./]') THEN list_concat([x], list_filter(string_split_regex(x, '[-./]'), lambda y: y <> '')) ELSE [x] END))"""
_BM25 = f"""c AS (SELECT chunk_id, doc_id, chunk_index, text, {_TOK.format(c='text')} AS t FROM {CHUNKS}),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM c) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM c),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, s GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOK.format(c='text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, p.chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))), 6) AS score
  FROM q JOIN idf USING (term) JOIN p USING (term) JOIN c ON c.chunk_id = p.chunk_id, s GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM scores WHERE score > 0 QUALIFY rank < 20)"""


def _d1(spark, d):
    index = R.build_index(chunks(spark, d), stored)
    return R.term_totals(index).withColumn("idf", F.round("idf", 6))


def _d1_maintained(spark, d):
    """An index that follows three batches: two thirds of the documents; the others, with every fifth one changed; deletions, and every eleventh one changed."""
    c = chunks(spark, d)
    index = MaintainedIndex(spark, shared_folder(spark), buckets=16)
    index.apply(c.where("doc_id % 3 > 0"))
    index.apply(c.where("doc_id % 3 = 0 AND doc_id % 5 > 0 OR doc_id % 5 = 0 AND chunk_index % 2 = 0"))
    again = c.where("doc_id % 11 = 0 AND doc_id % 7 > 0").withColumn("text", F.concat(F.lit("again "), "text"))
    index.apply(again, load(spark, d, "documents").where("doc_id % 7 = 0").select("doc_id"))
    return R.term_totals(index.index()).withColumn("idf", F.round("idf", 6))


_MAINTAINED = f"(SELECT chunk_id, doc_id, chunk_index, CASE WHEN doc_id % 11 = 0 THEN 'again ' || text ELSE text END AS text FROM {CHUNKS} WHERE doc_id % 7 > 0 AND (doc_id % 5 > 0 OR chunk_index % 2 = 0 OR doc_id % 11 = 0))"


def _sparse(spark, d, scope=Scope()):
    i = _index(spark, d)
    return stored(sparse_top_k(_questions(spark, d), i.tokens, i.terms, i.average, 20, scope, 6).withColumnRenamed("key", "chunk_id"))


def _d3(spark, d):
    return _once(spark, d, "sparse", lambda: _sparse(spark, d))


def _dense(spark, d, k=20):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    v = unit(e.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))
    return stored(dense_top_k(q, v, k, Scope(excluded=q.select("query_id", F.col("query_id").alias("doc_id"))), 6))


def _d4(spark, d):
    """A query doesn't find itself; every other one sees rows with its own label alone."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("vector"))
    closed = q.where("query_id % 200 = 0")
    allowed = e.select(F.col("vec_id").alias("doc_id"), "label").join(closed.select("query_id", "label"), "label").select("query_id", "doc_id")
    v = unit(e.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")))
    return dense_top_k(q, v, 20, Scope(closed.select("query_id"), allowed, q.select("query_id", F.col("query_id").alias("doc_id"))), 6)


_DENSE = """dense AS (SELECT q.vec_id AS query_id, v.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) - 1 AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id QUALIFY rank < 20)"""


def _legs(spark, d):
    """A dense leg, and a second one in another order that has no hit for every fourth query."""
    dense = _dense(spark, d)
    other = R.ranked(dense.where("query_id % 400 <> 0 AND key % 3 <> 0").drop("rank"), ["query_id"], F.col("key"))
    return dense, other


_LEGS = f"""{_DENSE}, other AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY key) - 1 AS rank FROM dense WHERE query_id % 400 <> 0 AND key % 3 <> 0),
every AS (SELECT query_id, key, rank, 0 AS leg FROM dense UNION ALL SELECT query_id, key, rank, 1 FROM other),
rrf AS (SELECT query_id, key, round(sum(1.0 / (61 + rank)), 6) AS score, min({{'leg': leg, 'rank': rank}}) AS seen, sum(1.0 / (61 + rank)) AS exact FROM every GROUP BY ALL),
plain AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, seen) - 1 AS rank FROM rrf),
fused AS (SELECT * FROM plain WHERE query_id IN (SELECT query_id FROM other) UNION ALL SELECT query_id, key, score, rank FROM dense WHERE query_id NOT IN (SELECT query_id FROM other))"""


def _d5(spark, d):
    dense, other = _legs(spark, d)
    return R.fuse_or_dense(dense, other, "key").withColumn("score", F.round("score", 6))


def _d6(spark, d):
    dense, other = _legs(spark, d)
    return R.rerank_skips(R.fuse_or_dense(dense, other, "key"), dense, "key", gap=0.1, least=0.36)


def _d7(spark, d):
    hits = _d3(spark, d)
    skips = hits.select("query_id", (F.col("query_id") % 5 == 0).alias("skip")).distinct()
    return R.rerank(hits, skips, _questions(spark, d), _chunks(spark, d), "chunk_id").withColumn("score", F.round("score", 6))


_STOP = "[" + ", ".join(f"'{x}'" for x in R.X.STOPWORDS) + "]"
_OVER = lambda c: f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3)), lambda t: NOT list_contains({_STOP}, t))"
_D7 = f"""{_BM25}, o AS (SELECT s.query_id, s.chunk_id, s.rank AS before, s.score AS given, {_OVER('b.text')} AS x, {_OVER('c.text')} AS y FROM sparse s JOIN benchmark b ON b.item_id = s.query_id JOIN c ON c.chunk_id = s.chunk_id),
n AS (SELECT query_id, chunk_id, before, given, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / sqrt(cast(len(x) * len(y) AS DOUBLE)) ELSE 0 END AS score FROM o),
final AS (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) - 1 AS rank FROM n WHERE query_id % 5 <> 0
  UNION ALL SELECT query_id, chunk_id, given, before FROM n WHERE query_id % 5 = 0)"""


def _files(spark, d):
    return load(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/Doc_"), "doc_id", F.lit(".txt")).alias("source_file"))


def _excluded(spark, d):
    """Every other query excludes each third file of those that it would find, in full or by base name."""
    docs = load(spark, d, "documents").select("doc_id", "lang")
    names = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x/dOC_"), "doc_id", F.lit(".TXT"))).otherwise(F.concat("lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))).alias("name"))
    found = _d3(spark, d).where("query_id % 2 = 0").select("query_id", F.split("chunk_id", ":")[0].cast("long").alias("doc_id")).distinct()
    return excluded_documents(found.join(names, "doc_id").select("query_id", "name"), _files(spark, d))


def _allowed(spark, d):
    """A third of the queries sees one source's documents, another one no documents, or two that are listed."""
    q = _questions(spark, d).select("query_id")
    source = q.where("query_id % 3 = 1").select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("source"))
    some = load(spark, d, "documents").select("doc_id", "source").join(source, "source").select("query_id", "doc_id")
    few = q.where("query_id % 9 = 2").select("query_id", F.explode(F.array(F.lit(0).cast("long"), F.col("query_id").cast("long"))).alias("doc_id"))
    return Scope(q.where("query_id % 3 > 0"), some.unionByName(few).distinct())


_SEES = """(q.item_id % 3 = 0 OR q.item_id % 3 = 1 AND d.source = 'src' || q.item_id % 20 OR q.item_id % 9 = 2 AND d.doc_id IN (0, q.item_id))"""
_EXCLUDES = "excl AS (SELECT DISTINCT query_id, doc_id FROM sparse JOIN c USING (chunk_id) WHERE query_id % 2 = 0 AND doc_id % 3 = 0)"
_SCOPED = """SELECT s.query_id, s.chunk_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.chunk_id) - 1 AS rank
  FROM scores s JOIN c USING (chunk_id) JOIN vis USING (query_id, doc_id) WHERE s.score > 0 QUALIFY rank < 20"""
_VIS = lambda sees, excludes: f"vis AS (SELECT q.item_id AS query_id, d.doc_id FROM benchmark q, documents d WHERE {sees} {'EXCEPT FROM excl' if excludes else ''})"


def _d8(spark, d):
    return _sparse(spark, d, Scope(excluded=_excluded(spark, d)))


def _d9(spark, d):
    return _sparse(spark, d, _allowed(spark, d))


def _d11(spark, d):
    return R.tidy(R.small(_d3(spark, d)), _chunks(spark, d), "chunk_id")  # so that texts aren't shuffled


_NORM = r"lower(regexp_replace(regexp_replace(c.text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g'))"
_TIDY = rf"""{_BM25}, u AS (SELECT s.*, {_NORM} AS norm, regexp_matches(c.text, '^\s*\|.*\|\s*$') AS bar FROM sparse s JOIN c ON c.chunk_id = s.chunk_id),
v AS (SELECT *, length(norm) < 100 AND rank > 0 AND NOT bar AS fragment FROM u QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank) = 1),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fragment, rank) <= 8),
tidied AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM w)"""


def _d10(spark, d):
    """Fused candidates and final hits of the whole pipeline, in the scope of allow-lists and exclusions."""
    scope = _allowed(spark, d)
    scope = Scope(scope.closed, scope.allowed, _excluded(spark, d))
    q = _questions(spark, d).withColumn("vector", _letters("question"))
    fused, final = R.retrieve(q, _index(spark, d), _chunks(spark, d), _vectors(spark, d), scope, digits=6, store=stored, gap=0.001, least=0.9)
    rows = fused.withColumn("list", F.lit("fused")).unionByName(final.withColumn("list", F.lit("final")))
    return rows.withColumn("score", F.round("score", 6))


def _letters(c):
    return F.array(*[(F.length(c) - F.length(F.replace(F.col(c), F.lit(x)))).cast("double") for x in _COUNTED])


_COUNTED = "etaoinshrdlu"
#: A counted letter's place, or that behind all of them.
_PLACES = bytes(_COUNTED.index(chr(x)) if chr(x) in _COUNTED else len(_COUNTED) for x in range(256))


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(_COUNTED)
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            rows = batch.slice(a, 1024)
            texts = pc.cast(rows.column("text"), pa.large_binary())
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            places = np.frombuffer(b"".join(x for x in texts.to_pylist() if x).translate(_PLACES), np.uint8)
            counts = np.bincount(np.repeat(np.arange(len(size)) * (n + 1), size) + places, minlength=len(size) * (n + 1)).reshape(-1, n + 1)[:, :n]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * n, pa.int32()), pa.array(counts.astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("doc_id"), lists], ["key", "doc_id", "vector"])


def _lettered(texts):
    """(key, doc_id, vector) of texts (key, doc_id, text), as _letters() counts, in one pass over the bytes of a batch."""
    ship(texts.sparkSession)
    return texts.mapInArrow(_letter_counts, "key string, doc_id long, vector array<double>")


_LETTERS = lambda c: "[" + ", ".join(f"cast(length({c}) - length(replace({c}, '{x}', '')) AS DOUBLE)" for x in _COUNTED) + "]"
_COS = "round(coalesce(CASE WHEN list_dot_product(x, x) > 0 AND list_dot_product(y, y) > 0 THEN list_cosine_similarity(x, y) END, 0), 6)"
_D10 = rf"""{_BM25}, {_EXCLUDES}, {_VIS(_SEES, True)}, scoped AS ({_SCOPED}),
qv AS (SELECT item_id AS query_id, {_LETTERS('text')} AS x FROM benchmark), cv AS (SELECT chunk_id, doc_id, {_LETTERS('text')} AS y FROM c),
dense AS (SELECT query_id, chunk_id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, chunk_id) - 1 AS rank FROM qv JOIN vis USING (query_id) JOIN cv USING (doc_id) QUALIFY rank < 20),
every AS (SELECT query_id, chunk_id, rank, 0 AS leg FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM scoped),
rrf AS (SELECT query_id, chunk_id, min({{'leg': leg, 'rank': rank}}) AS seen, sum(1.0::DOUBLE / (61 + rank)) AS score FROM every GROUP BY ALL),
plain AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM rrf),
fused AS (SELECT * FROM plain WHERE query_id IN (SELECT query_id FROM scoped) UNION ALL SELECT query_id, chunk_id, score, rank FROM dense WHERE query_id NOT IN (SELECT query_id FROM scoped)),
gate AS (SELECT f.query_id, coalesce(n > 1 AND s0 - (s - s0) / (n - 1) > 0.001 AND s0 > 0.9 AND first = winner, false) OR m <= 12 AS skip FROM (SELECT query_id, count(*) AS m, arg_min(chunk_id, rank) AS winner FROM fused GROUP BY 1) f
  LEFT JOIN (SELECT query_id, max(score) AS s0, sum(score) AS s, count(*) AS n, arg_min(chunk_id, rank) AS first FROM dense GROUP BY 1) g USING (query_id)),
o AS (SELECT s.query_id, s.chunk_id, s.rank AS before, s.score AS given, skip, {_OVER('b.text')} AS x, {_OVER('c.text')} AS y FROM fused s JOIN gate USING (query_id) JOIN benchmark b ON b.item_id = s.query_id JOIN c ON c.chunk_id = s.chunk_id),
nn AS (SELECT *, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / sqrt(cast(len(x) * len(y) AS DOUBLE)) ELSE 0 END AS sc FROM o),
final AS (SELECT query_id, chunk_id, round(sc, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, before) - 1 AS rank FROM nn WHERE NOT skip UNION ALL SELECT query_id, chunk_id, round(given, 6), before FROM nn WHERE skip),
u AS (SELECT s.*, {_NORM} AS norm, regexp_matches(c.text, '^\s*\|.*\|\s*$') AS bar FROM final s JOIN c ON c.chunk_id = s.chunk_id WHERE s.rank < 12),
v AS (SELECT *, length(norm) < 100 AND rank > 0 AND NOT bar AS fragment FROM u QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY rank) = 1),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fragment, rank) <= 8)"""


def _d12(spark, d):
    """Questions about several things: a question's four quarters are retrieved by themselves, and merged with its own hits."""
    q = _questions(spark, d)
    words, n = F.split("question", " "), F.ceil(F.size(F.split("question", " ")) / 4).cast("int")
    parts = q.select("query_id", words.alias("w"), n.alias("n"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("entity"))
    asked = parts.select("query_id", "entity", F.array_join(F.slice("w", (F.col("entity") - 1) * F.col("n") + 1, F.col("n")), " ").alias("question")).where("question <> ''")
    pool, final = R.retrieve_multi(q.withColumn("vector", _letters("question")), asked.withColumn("vector", _letters("question")), _index(spark, d), _chunks(spark, d), _vectors(spark, d), digits=6, store=stored)
    return final.select("query_id", "chunk_id", "rank", F.lit("final").alias("list")).unionByName(pool.select("query_id", "chunk_id", F.lit(None).cast("long").alias("rank"), F.lit("pool").alias("list")))


def _d13(spark, d):
    return R.expand_neighbours(stored(_d11(spark, d)), _chunks(spark, d)).withColumn("score", F.round("score", 6))


_CONT = lambda a, b: " OR ".join(f"regexp_matches({x}, '{p}')" for x in (a, b) for p in (r"^\s*\|.*\|\s*$", r"^\s*(\(?\d{1,2}[.)]|[Ss][Tt][Ee][Pp]\s+\d+|[a-h][.)])\s+\S"))
_D13 = f"""{_TIDY}, h AS (SELECT t.*, c.doc_id, c.chunk_index, c.text FROM tidied t JOIN c ON c.chunk_id = t.chunk_id),
a AS (SELECT h.query_id, h.rank, h.score, s.step, c.chunk_id FROM h CROSS JOIN (VALUES (1), (-1)) s(step) JOIN c ON c.doc_id = h.doc_id AND c.chunk_index = h.chunk_index + s.step
  WHERE ({_CONT('h.text', 'c.text')}) AND NOT EXISTS (SELECT 1 FROM tidied t WHERE t.query_id = h.query_id AND t.chunk_id = c.chunk_id)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, step DESC) = 1),
e AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, step DESC) <= 4),
z AS (SELECT query_id, chunk_id, score, rank, 0 AS step FROM tidied UNION ALL SELECT query_id, chunk_id, score, rank, step FROM e)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, step) - 1 AS rank FROM z"""


def _d14(spark, d):
    return R.sandwich(_d11(spark, d)).select("query_id", "chunk_id", "place")


def _d15(spark, d):
    c = _chunks(spark, d).select("chunk_id", F.concat(F.lit("doc_"), "doc_id").alias("source_file"), F.col("chunk_index").alias("page"), F.when(F.col("lang") == "en", F.lit("Main")).alias("section"), "text")
    return R.prompt_blocks(_d11(spark, d), c).select("query_id", F.md5("prompt").alias("digest"))


def _d16(spark, d):
    return _questions(spark, d).select("query_id", R.instructed(F.col("question"), F.when(F.col("query_id") % 2 == 0, F.lit("Find passages"))).alias("text"))


def _b13(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", R.context_prefix(F.concat(F.lit("doc_"), "doc_id"), F.col("chunk_index"), F.when(F.col("lang") == "en", F.lit("Main"))).alias("prefix"))


def _slice(spark, d):
    """The flagship: BM25 top 20 of benchmark items, and how many of the documents that hold an item are found."""
    hits = _d3(spark, d).join(_chunks(spark, d).select("chunk_id", "doc_id"), "chunk_id")
    found = hits.select("query_id", "doc_id").distinct()
    expected = R.containing(_questions(spark, d), load(spark, d, "documents").select("doc_id", "text"), owner="doc_id", text="text")
    joined = expected.join(found.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return _questions(spark, d).select("query_id").join(joined.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall_at_20")), "query_id", "left")


def _letter_model():
    """An embedder as a model would be plugged in: an iterator pandas UDF, here of letter counts."""

    @F.pandas_udf("array<double>")
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(t.count(x)) for x in "etaoinshrdlu"] for t in texts])

    return model


_FROM = lambda ctes, body: f"WITH {ctes} {body}"
QUERIES = {
    "retrieval_slice": (
        _slice,
        _FROM(_BM25, ", x AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT DISTINCT query_id, doc_id FROM sparse JOIN c USING (chunk_id)) SELECT b.item_id AS query_id, r AS recall_at_20 FROM benchmark b LEFT JOIN (SELECT x.query_id, round(count(f.doc_id) / count(*), 6) AS r FROM x LEFT JOIN f USING (query_id, doc_id) GROUP BY ALL) y ON y.query_id = b.item_id"),
    ),
    "b13_context_prefix": (_b13, f"SELECT chunk_id, '[Source: doc_' || doc_id || ' | Page: ' || chunk_index || CASE WHEN lang = 'en' THEN ' | Section: Main' ELSE '' END || ']' AS prefix FROM {CHUNKS}"),
    "d1_inverted_index": (_d1, _FROM(_BM25, "SELECT term, cast(sum(tf) AS BIGINT) AS tf, count(*) AS df, round(max(idf), 6) AS idf FROM p JOIN idf USING (term) GROUP BY term")),
    "d1_maintained_index": (_d1_maintained, _FROM(_BM25.replace(CHUNKS, _MAINTAINED), "SELECT term, cast(sum(tf) AS BIGINT) AS tf, count(*) AS df, round(max(idf), 6) AS idf FROM p JOIN idf USING (term) GROUP BY term")),
    "d2_bm25": (_scores, _FROM(_BM25, "SELECT * FROM scores")),
    "d3_sparse_top_k": (_d3, _FROM(_BM25, "SELECT * FROM sparse")),
    "d4_dense_top_k": (_d4, _FROM(_DENSE.replace("v.vec_id <> q.vec_id", "v.vec_id <> q.vec_id AND (q.vec_id % 200 <> 0 OR v.label = q.label)"), "SELECT * FROM dense")),
    "d5_rank_fusion": (_d5, _FROM(_LEGS, "SELECT * FROM fused")),
    "d6_rerank_gate": (
        _d6,
        _FROM(_LEGS, "SELECT f.query_id, coalesce(n > 1 AND s0 - (s - s0) / (n - 1) > 0.1 AND s0 > 0.36 AND first = winner, false) OR m <= 12 AS skip FROM (SELECT query_id, count(*) AS m, arg_min(key, rank) AS winner FROM fused GROUP BY 1) f LEFT JOIN (SELECT query_id, max(score) AS s0, sum(score) AS s, count(*) AS n, arg_min(key, rank) AS first FROM dense GROUP BY 1) d USING (query_id)"),
    ),
    "d7_rerank": (_d7, _FROM(_D7, "SELECT * FROM final WHERE rank < 12")),
    "d8_exclusion": (_d8, _FROM(_BM25 + ", " + _EXCLUDES + ", " + _VIS("true", True), _SCOPED)),
    "d9_scope": (_d9, _FROM(_BM25 + ", " + _VIS(_SEES, False), _SCOPED)),
    "d10_pipeline": (_d10, _FROM(_D10, """SELECT query_id, chunk_id, round(score, 6) AS score, rank, 'fused' AS list FROM fused
  UNION ALL SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1, 'final' FROM w""")),
    "d11_tidy": (_d11, _FROM(_TIDY, "SELECT * FROM tidied")),
    "d12_entity_merge": (_d12, None),
    "d13_neighbours": (_d13, "WITH " + _D13),
    "d14_sandwich": (_d14, _FROM(_TIDY, "SELECT query_id, chunk_id, CASE WHEN n <= 2 THEN rank WHEN rank % 2 = 0 THEN rank // 2 ELSE n - 1 - (rank - 1) // 2 END AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM tidied)")),
    "d15_prompt": (
        _d15,
        _FROM(_TIDY, f"""SELECT query_id, md5(string_agg('[Source ' || rank + 1 || '] (File: doc_' || k.doc_id || ', Page: ' || k.chunk_index || CASE WHEN lang = 'en' THEN ', Section: Main' ELSE '' END || ')' || chr(10) || '"' || k.text || '"', chr(10) || chr(10) ORDER BY rank)) AS digest FROM tidied t JOIN {CHUNKS} k ON k.chunk_id = t.chunk_id GROUP BY query_id"""),
    ),
    "d17_embedded": (
        lambda s, d: R.embed(chunks(s, d).select("chunk_id", "text"), "text", _letter_model()).select("chunk_id", F.array_join(F.transform("vector", lambda x: x.cast("long").cast("string")), ",").alias("vector")),
        f"SELECT chunk_id, array_to_string(list_transform({_LETTERS('text')}, lambda x: cast(x AS BIGINT)), ',') AS vector FROM {CHUNKS}",
    ),
    "d16_instruction": (_d16, "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'Instruct: Find passages' || chr(10) || 'Query: ' || text ELSE text END AS text FROM benchmark"),
}
