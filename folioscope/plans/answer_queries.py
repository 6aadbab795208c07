"""Queries of citations and of the knowledge graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from folioscope.operators import citations as C
from folioscope.operators import graph as G
from folioscope.plans.tables import CHUNKS, chunks, load


def _answers(spark, d):
    """Assistant turns with markers behind, inside and before the text; sources are the lines of document conv_id."""
    t = load(spark, d, "conversations").where("role = 'assistant'")
    k, half = F.col("turn") % 5, (F.length("text") / 2).cast("int")
    text = F.concat(
        F.when(k == 1, F.lit("[Source 2]")).otherwise(F.lit("")), F.substring("text", F.lit(1), half), F.lit(" [Source "), k + 1, F.lit("]"), F.lit(" [Sources 1-3, x, 9-2] "),
        F.substring("text", half + 1, F.length("text")), F.when(k == 2, F.lit("")).otherwise(F.lit("[Source 1, 3]")), F.when(k == 3, F.lit(" tail without a source")).otherwise(F.lit("")),
    )
    c = chunks(spark, d)
    n = G.ranked(c, ["doc_id"], F.col("chunk_index"), name="i")
    sources = n.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "doc_id", (F.col("i") / 2).cast("int").alias("page"), "text"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["page"].alias("page"), x["text"].alias("text"))).alias("sources"))
    return t.join(sources, t["conv_id"] == sources["doc_id"]).select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), text.alias("text"), "sources")


_A = f"""n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS i FROM {CHUNKS}),
src AS (SELECT doc_id, i + 1 AS number, i // 2 AS page, text FROM n),
ans AS (SELECT conv_id || ':' || turn AS answer_id, conv_id, CASE WHEN turn % 5 = 1 THEN '[Source 2]' ELSE '' END || substr(text, 1, length(text) // 2) || ' [Source ' || turn % 5 + 1 || ']' || ' [Sources 1-3, x, 9-2] ' ||
  substr(text, length(text) // 2 + 1) || CASE WHEN turn % 5 = 2 THEN '' ELSE '[Source 1, 3]' END || CASE WHEN turn % 5 = 3 THEN ' tail without a source' ELSE '' END AS text,
  (SELECT count(*) FROM src WHERE src.doc_id = conv_id) AS n FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT doc_id FROM src)),
seg AS (SELECT answer_id, conv_id, n, i - 1 AS seg, x[i] AS text, m[i] AS marker FROM (SELECT answer_id, conv_id, n, x, m, unnest(range(1, len(x) + 1)) AS i FROM
  (SELECT answer_id, conv_id, n, string_split_regex(text, '\\[Sources?\\s+([\\d,\\s\\-]+)\\]') AS x, regexp_extract_all(text, '\\[Sources?\\s+([\\d,\\s\\-]+)\\]', 1) AS m FROM ans))),
cited AS (SELECT answer_id, conv_id, n, seg, text, marker, flatten(list_transform(string_split(coalesce(marker, ''), ','), lambda p: CASE WHEN regexp_matches(p, '^\\s*\\d+\\s*$') THEN [cast(trim(p) AS INTEGER)]
  WHEN regexp_matches(p, '^\\s*\\d+\\s*-\\s*\\d+\\s*$') THEN list_transform(range(cast(trim(string_split(p, '-')[1]) AS BIGINT), cast(trim(string_split(p, '-')[2]) AS BIGINT) + 1), lambda q: cast(q AS INTEGER)) ELSE [] END)) AS c FROM seg),
num AS (SELECT answer_id, conv_id, n, seg, j - 1 AS pos, c[j] AS number FROM (SELECT *, unnest(range(1, len(c) + 1)) AS j FROM cited)),
col AS (SELECT num.answer_id, seg, pos, number, first_value(number) OVER (PARTITION BY num.answer_id, page ORDER BY seg, pos) AS citation FROM num JOIN src USING (number) WHERE src.doc_id = conv_id),
ids AS (SELECT answer_id, seg, list(citation ORDER BY pos) AS ids FROM col GROUP BY ALL),
grp AS (SELECT s.*, coalesce(ids, []) AS ids, regexp_matches(text, '\\S') OR seg = 0 AS starts, sum(CASE WHEN regexp_matches(text, '\\S') OR seg = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY answer_id ORDER BY seg) - 1 AS span FROM seg s LEFT JOIN ids USING (answer_id, seg)),
pre AS (SELECT answer_id, conv_id, cast(span AS INTEGER) AS span, max(text) FILTER (starts) AS text, flatten(list(ids ORDER BY seg)) AS raw, bool_or(marker IS NOT NULL) AS marked FROM grp GROUP BY ALL),
spans AS (SELECT answer_id, conv_id, span, text, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS ids FROM pre WHERE regexp_matches(text, '\\S') OR marked OR span = 0)""".replace("\\\\", "\\")
_STOP = "[" + ", ".join(f"'{x}'" for x in C.X.STOPWORDS) + "]"
_OVER = lambda c: f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3)), lambda t: NOT list_contains({_STOP}, t))"
_TRIM = r"regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_R = f"""{_A}, cand AS (SELECT * FROM (SELECT *, {_OVER('text')} AS t FROM spans WHERE len(ids) > 0 AND length({_TRIM}) >= 20) WHERE len(t) >= 3),
sc AS (SELECT answer_id, span, ids, number, CASE WHEN len(st) > 0 THEN len(list_intersect(t, st)) / sqrt(cast(len(t) * len(st) AS DOUBLE)) ELSE 0 END AS score
  FROM cand JOIN (SELECT doc_id, number, {_OVER('substr(text, 1, 1500)')} AS st FROM src) s ON s.doc_id = conv_id),
bst AS (SELECT answer_id, span, max(score) AS top, arg_max(number, score * 1000000 - number * 0.001) AS number, max(score) FILTER (list_contains(ids, number)) AS now FROM sc GROUP BY ALL),
mv AS (SELECT answer_id, span, number AS best FROM bst WHERE top >= 0.12 AND top >= coalesce(now, 0) + 0.08),
al AS (SELECT s.answer_id, conv_id, s.span, text, CASE WHEN best IS NOT NULL THEN [best] ELSE ids END AS ids FROM spans s LEFT JOIN mv USING (answer_id, span))"""


def _joined(rows):
    return rows.select("answer_id", "span", "text", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _f3(spark, d):
    a = _answers(spark, d)
    found, dropped = C.valid_numbers(a)
    return dropped.join(found.groupBy("answer_id").agg(F.count(F.lit(1)).alias("valid")), "answer_id", "left").select("answer_id", "dropped", F.coalesce("valid", F.lit(0)).alias("valid"))


def _f5(spark, d):
    a = _answers(spark, d)
    return _joined(C.realigned(C.spans(a), a))


def _f7(spark, d):
    a = _answers(spark, d)
    return C.used_sources(C.realigned(C.spans(a), a), a)


def _f8(spark, d):
    rows = C.records(C.spans(_answers(spark, d)))
    return rows.select("answer_id", F.size(F.from_json("record", "array<struct<text:string,ids:array<int>>>")).cast("long").alias("spans"))


def _graph(spark, d):
    """Parts and orders as entities, each line item as a relationship."""
    p = load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 5).alias("document_id"), F.col("p_type").alias("description"))
    o = load(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), (F.col("o_orderkey") % 5).alias("document_id"), F.col("o_orderpriority").alias("description"))
    rel = load(spark, d, "lineitem").select(
        F.concat_ws("-", "l_partkey", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("o"), "l_orderkey").alias("target_id"),
        F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("ordered_in")).alias("relation_type"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("")).otherwise(F.lit("a line of it")).alias("description"),
    )
    return p.unionByName(o), rel


_G = """ent AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_partkey % 5 AS document_id, p_type AS description FROM part UNION ALL SELECT 'o' || o_orderkey, 'Order ' || o_orderkey, o_orderkey % 5, o_orderpriority FROM orders),
rel AS (SELECT l_partkey || '-' || l_orderkey || '-' || l_linenumber AS id, 'p' || l_partkey AS source_id, 'o' || l_orderkey AS target_id, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'ordered_in' END AS relation_type,
  CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'a line of it' END AS description FROM lineitem),
own AS (SELECT * FROM ent WHERE document_id < 4), inn AS (SELECT * FROM rel WHERE source_id IN (SELECT id FROM own) AND target_id IN (SELECT id FROM own)),
edge AS (SELECT source_id AS a, target_id AS b, relation_type, description, id AS rel FROM inn UNION ALL SELECT target_id, source_id, relation_type, description, id FROM inn),
seed AS (SELECT id, id AS query_id FROM own WHERE id LIKE 'p%'),
h1 AS (SELECT query_id, b AS id, 1 AS hop, min({'p': a, 'r': rel, 't': relation_type, 'd': description}) AS x FROM seed JOIN edge ON seed.id = a WHERE b <> query_id GROUP BY query_id, b),
h2 AS (SELECT query_id, b AS id, 2 AS hop, min({'p': a, 'r': rel, 't': relation_type, 'd': description}) AS x FROM h1 JOIN edge ON h1.id = a WHERE b <> query_id AND NOT EXISTS (SELECT 1 FROM h1 y WHERE y.query_id = h1.query_id AND y.id = b) GROUP BY query_id, b),
hops AS (SELECT query_id, id, hop, x.p AS parent, x.t AS relation_type, x.d AS description FROM h1 UNION ALL SELECT query_id, id, hop, x.p, x.t, x.d FROM h2),
dsc AS (SELECT query_id, h.id, hop, parent, CASE WHEN relation_type = '' THEN 'related_to' ELSE relation_type END AS relation_type, CASE WHEN h.description = '' THEN own.description ELSE h.description END AS description, name FROM hops h JOIN own USING (id))"""


def _walk(spark, d, enough=None):
    e, r = _graph(spark, d)
    own = e.where("document_id < 4")
    seeds = own.where("id LIKE 'p%'").select("id", F.col("id").alias("query_id"))
    return own, G.k_hop(seeds, G.both_ways(r), within=own, enough=enough)


def _e1(spark, d):
    e = load(spark, d, "events")
    good = F.concat(F.lit('```json\n{"entities": [{"name": "u'), "user_id", F.lit('", "type": "user"}, {"name": "", "type": "none"}], "relationships": [{"source": "u'), "user_id", F.lit('", "target": "'), "event_type", F.lit('", "relation": "did"}]}\n```'))
    replies = e.select((F.col("event_id") % 10).alias("document_id"), F.col("event_id").alias("chunk_index"), F.when(F.col("event_id") % 4 == 0, F.lit("{oops")).otherwise(good).alias("reply"))
    ent, rel, bad = G.parse_replies(replies)
    count = lambda df, kind: df.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(ent, "entity").unionByName(count(rel, "relationship")).unionByName(count(bad, "malformed"))


def _e2(spark, d):
    e = load(spark, d, "events")
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("name"), (F.col("event_id") % 10).alias("document_id"), F.col("event_id").alias("chunk_index"), F.lit(0).alias("pos"))
    return G.dedup_entities(rows.where("chunk_index % 100 >= 90"), rows.where("chunk_index % 100 < 90")).select("name", "document_id", "chunk_index")


def _e3(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return G.match_entities(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), least=0.2)


def _e4(spark, d):
    e, _ = _graph(spark, d)
    q = load(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("What is "), F.upper("p_name"), F.lit("?")).alias("question"))
    return G.match_by_name(q, e)


def _e5(spark, d):
    e, r = _graph(spark, d)
    names = e.select("id", F.col("name"))
    rel = r.join(names.select(F.col("id").alias("source_id"), F.upper("name").alias("source")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    rel = rel.select("id", "source", F.when(F.substring("id", -1, 1) == "1", F.lit("nobody")).otherwise(F.col("target")).alias("target"))
    return G.resolve_relationships(rel, e).select("id", "source_id", "target_id")


def _e11(spark, d):
    e, _ = _graph(spark, d)
    gone = load(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("document_id")).where("document_id < 2")
    return G.delete_document(e, gone).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def _e7(spark, d):
    return _walk(spark, d)[1].drop("description", "relation_type")


def _e8(spark, d):
    own, reached = _walk(spark, d)
    return G.described(reached, own).select("query_id", "id", "hop", "relation_type", "description", "name")


def _e10(spark, d):
    own, reached = _walk(spark, d, enough=10)  # lines of a context
    return G.graph_context(G.described(reached, own))


def _length_model():
    @F.pandas_udf("array<double>")
    def model(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(t))] for t in texts])

    return model


QUERIES = {
    "f1_segments": (lambda s, d: C.segments(_answers(s, d)).select("answer_id", F.col("seg"), "text", "marked"), f"WITH {_A} SELECT answer_id, seg, text, marker IS NOT NULL AS marked FROM seg"),
    "f2_number_lists": (lambda s, d: C.segments(_answers(s, d)).select("answer_id", "seg", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited")), f"WITH {_A} SELECT answer_id, seg, array_to_string(c, ',') AS cited FROM cited"),
    "f3_valid_numbers": (_f3, f"WITH {_A} SELECT answer_id, count(*) FILTER (number < 1 OR number > n) AS dropped, count(*) FILTER (number BETWEEN 1 AND n) AS valid FROM num GROUP BY answer_id"),
    "f4_collapsed": (lambda s, d: C.collapsed(_answers(s, d)), f"WITH {_A} SELECT * FROM col"),
    "f5_realigned": (_f5, f"WITH {_R} SELECT answer_id, span, text, array_to_string(ids, ',') AS ids FROM al"),
    "f6_spans": (lambda s, d: _joined(C.spans(_answers(s, d))), f"WITH {_A} SELECT answer_id, span, text, array_to_string(ids, ',') AS ids FROM spans"),
    "f7_used_sources": (_f7, f"WITH {_R}, i AS (SELECT DISTINCT answer_id, conv_id, unnest(ids) AS number FROM al) SELECT answer_id, number, doc_id, page, substr(text, 1, 500) AS quote FROM i JOIN src USING (number) WHERE doc_id = conv_id"),
    "f8_answer_record": (_f8, f"WITH {_A} SELECT answer_id, count(*) AS spans FROM spans GROUP BY answer_id"),
    "e1_parsed_replies": (
        _e1,
        "SELECT event_id % 10 AS document_id, count(*) AS n, 'entity' AS kind FROM events WHERE event_id % 4 <> 0 GROUP BY 1 UNION ALL SELECT event_id % 10, count(*), 'relationship' FROM events WHERE event_id % 4 <> 0 GROUP BY 1 UNION ALL SELECT event_id % 10, count(*), 'malformed' FROM events WHERE event_id % 4 = 0 GROUP BY 1",
    ),
    "e2_entity_dedup": (_e2, "SELECT 'u' || user_id AS name, event_id % 10 AS document_id, event_id AS chunk_index FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY event_id % 100 < 90, event_id) = 1"),
    "e3_entity_match": (
        _e3,
        "SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) - 1 AS rank FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) >= 0.2 QUALIFY rank < 5",
    ),
    "e4_name_match": (_e4, f"WITH {_G} SELECT p_partkey AS query_id, id FROM part JOIN ent ON contains('what is ' || lower(p_name) || '?', lower(name))"),
    "e5_resolved": (
        _e5,
        f"WITH {_G}, nm AS (SELECT lower(name) AS k, min(id) AS i FROM ent GROUP BY 1) SELECT rel.id, a.i AS source_id, b.i AS target_id FROM rel JOIN ent s ON s.id = source_id JOIN ent t ON t.id = target_id JOIN nm a ON a.k = lower(s.name) JOIN nm b ON b.k = lower(t.name) WHERE rel.id NOT LIKE '%1'",
    ),
    "e6_induced_edges": (lambda s, d: (lambda e, r: G.induced_edges(e.where("document_id < 4"), r))(*_graph(s, d)), f"WITH {_G} SELECT * FROM edge"),
    "e7_two_hops": (_e7, f"WITH {_G} SELECT query_id, id, hop, parent FROM hops"),
    "e8_relations": (_e8, f"WITH {_G} SELECT query_id, id, hop, relation_type, description, name FROM dsc"),
    "e9_walk": (
        lambda s, d: (lambda e, r: G.walk(e.where("id LIKE 'p%'").select("id", F.col("id").alias("query_id")), r, e))(*_graph(s, d)),
        f"WITH {_G.replace('FROM inn', 'FROM rel').replace('FROM own WHERE id LIKE', 'FROM ent WHERE id LIKE')} SELECT query_id, h.id, hop, relation_type, CASE WHEN h.description = '' THEN ent.description ELSE h.description END AS description, name FROM hops h JOIN ent ON ent.id = h.id",
    ),
    "e12_name_vectors": (
        lambda s, d: G.vectors_of_names(_graph(s, d)[0].select("id", "name"), _length_model()).select("id", F.col("vector")[0].alias("length")),
        f"WITH {_G} SELECT id, cast(length(name) AS DOUBLE) AS length FROM ent",
    ),
    "e10_context": (
        _e10,
        f"WITH {_G} SELECT query_id, string_agg('- ' || name || ' (' || relation_type || '): ' || description, chr(10) ORDER BY rank) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS rank FROM dsc QUALIFY rank <= 10) GROUP BY query_id",
    ),
    "e11_deleted": (_e11, f"WITH {_G} SELECT document_id, count(*) AS n FROM ent WHERE document_id >= 2 GROUP BY 1"),
}
