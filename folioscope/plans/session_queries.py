"""Queries of sessions, of shaping, of tables as text and stores, and of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import conversation as G
from folioscope.operators import shaping as S
from folioscope.plans.tables import CHUNKS, PAGES, chunks, load, pages, shared_folder
from folioscope.sources.store import BucketStore, worked_out
from folioscope.streaming import live as L


def _turns(s, d):
    """User turns with the assistant turn behind them."""
    t = load(s, d, "conversations").where("role IN ('user', 'assistant')")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.withColumn("answer", F.lead("text").over(w)).withColumn("_r", F.lead("role").over(w)).where("role = 'user' AND _r = 'assistant'")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), F.col("text").alias("user_query"), "answer", F.when(F.col("turn") % 4 != 0, X.word_count(F.col("answer"))).alias("tokens"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"))


_T = r"""t AS (SELECT conv_id AS session_id, turn AS turn_number, text AS user_query, a AS answer, CASE WHEN turn % 4 <> 0 THEN len(regexp_extract_all(a, '[^ \t\n\x0B\f\r]+')) END AS tokens, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS ts
  FROM (SELECT *, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')"""


def _sessions(s, d):
    g = _turns(s, d).groupBy("session_id").agg(F.min("user_query").alias("q"))
    return g.select("session_id", F.when(F.col("session_id") % 3 != 0, F.substring("q", 1, 80)).alias("summary"), F.array(F.substring("q", 1, 30), F.substring("q", 31, 600), F.substring("q", 5, 20)).alias("key_facts"))


_S = "ses AS (SELECT session_id, CASE WHEN session_id % 3 <> 0 THEN substr(min(user_query), 1, 80) END AS summary, [substr(min(user_query), 1, 30), substr(min(user_query), 31, 600), substr(min(user_query), 5, 20)] AS facts FROM t GROUP BY 1)"
_N = lambda c: rf"len(regexp_extract_all({c}, '[^ \t\n\x0B\f\r]+'))"
_G2 = f"""{_T}, {_S}, p AS (SELECT session_id, 0 AS kind, 0 AS place, 'Summary: ' || summary AS part FROM ses WHERE summary IS NOT NULL
  UNION ALL SELECT session_id, 1, i - 1, '- ' || facts[i] FROM (SELECT *, unnest([1, 2, 3]) AS i FROM ses)
  UNION ALL SELECT session_id, 2, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) - 1 AS n, 'User: ' || user_query || chr(10) || 'Assistant: ' || substr(answer, 1, 150) FROM t QUALIFY n < 5),
c AS (SELECT *, {_N('part')} AS cost, sum({_N('part')}) OVER (PARTITION BY session_id, kind ORDER BY place) AS run FROM p),
k0 AS (SELECT * FROM c WHERE kind = 0 AND run <= 1500), s0 AS (SELECT session_id, sum(cost) AS s FROM k0 GROUP BY 1),
k1 AS (SELECT c.* FROM c LEFT JOIN s0 USING (session_id) WHERE kind = 1 AND coalesce(s, 0) + run <= 1500), s1 AS (SELECT session_id, sum(cost) AS s FROM (FROM k0 UNION ALL FROM k1) GROUP BY 1),
k2 AS (SELECT c.* FROM c LEFT JOIN s1 USING (session_id) WHERE kind = 2 AND coalesce(s, 0) + run <= 1500)
SELECT session_id, md5(string_agg(part, chr(10) ORDER BY kind, place)) AS context, cast(sum(cost) AS BIGINT) AS tokens FROM (FROM k0 UNION ALL FROM k1 UNION ALL FROM k2) GROUP BY 1"""


def _g2(s, d):
    r = G.conversation_context(_turns(s, d), _sessions(s, d), budget=1500)
    return r.select("session_id", F.md5("context").alias("context"), F.col("tokens").cast("long").alias("tokens"))


def _g1(s, d):
    words = F.get(F.array(*map(F.lit, ("List all docs ", "list files about ", "what is ", "Show me all "))), (F.col("conv_id") % 4).cast("int"))
    return load(s, d, "conversations").select("conv_id", "turn", G.intent(F.concat(words, "text")).alias("i")).select("conv_id", "turn", "i.intent", "i.confidence")


def _g6(s, d):
    e = load(s, d, "events")
    i = F.col("event_id")
    resolved = F.when(i % 5 != 0, F.array((i % 4).cast("string"), (i % 3).cast("string")))
    scope = F.when(i % 7 != 0, F.array((i % 3).cast("string")))
    return e.select("event_id", F.array_join(G.scoped(resolved, scope), ",").alias("ids"))


def _g7(s, d):
    e = load(s, d, "events")
    i = F.col("event_id")
    reply = F.when(i % 4 == 0, F.lit("{bad")).when(i % 4 == 1, F.concat(F.lit('```json\n{"mode": "library", "rewritten_query": " q'), i, F.lit(' "}\n```'))).when(i % 4 == 2, F.lit('{"mode": "other", "rewritten_query": "  "}')).otherwise(F.lit('{"mode": "compound"}'))
    return e.select("event_id", G.routing(reply, F.col("event_type")).alias("r")).select("event_id", "r.mode", "r.query")


def _g8(s, d):
    e = load(s, d, "events")
    i = F.col("event_id")
    reply = F.when(i % 3 == 0, F.lit("nope")).otherwise(F.concat(F.lit('{"summary": "s'), i, F.lit('", "key_facts": [{"fact": "f", "source": "x"}, {"fact": "g"}]}')))
    return e.select("event_id", G.updated_memory(F.lit("old"), F.array(F.lit("o|x|1")), reply, i % 5 + 1).alias("m")).select("event_id", "m.summary", F.array_join("m.facts", ";").alias("facts"))


def _g10(s, d):
    t = load(s, d, "conversations")
    i = F.col("turn") % 4
    text = F.col("text")
    a = F.when(i == 0, F.concat(text, F.lit(" [[FILE_LIST]] and [[FILE_LIST]] end"))).when(i == 1, F.concat(text, F.lit(" [[FILE_  "))).when(i == 2, F.lit("[[FILE_LIST]]")).otherwise(text)
    return t.select("conv_id", "turn", G.spliced(a, F.lit("- a\n- b")).alias("answer"))


def _g13(s, d):
    e = load(s, d, "events")
    i = F.col("event_id")
    mode = F.get(F.array(*map(F.lit, ("library", "compound", "retrieval"))), (i % 3).cast("int"))
    return e.select("event_id", G.outcome(mode, i % 2, i % 5 == 0).alias("o")).select("event_id", "o.*")


def _g12(s, d):
    e = load(s, d, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_seen"))
    logins = e.select(F.col("user_id").alias("id"), "last_seen", F.timestamp_seconds(F.lit(1704067200) + F.col("user_id") % 60 * 86400).alias("ends_at"))
    return G.expired(logins, F.timestamp_seconds(F.lit(1704067200 + 30 * 86400))).select("id")


def _g11(s, d):
    t = _turns(s, d).select("session_id", "turn_number", "user_query")
    new = t.where("turn_number < 4").select("session_id", F.col("turn_number").alias("place"), F.concat(F.lit("again "), "user_query").alias("user_query"))
    return G.appended(t, new).select("session_id", "turn_number", F.md5("user_query").alias("q"))


def _paragraphs(s, d):
    c = chunks(s, d)
    return c.select("doc_id", F.col("chunk_index").alias("place"), "text", (F.length("text") < 60).alias("is_heading"))


def _blocks(s, d):
    p = load(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:p|li)>([^<]*)<"), F.lit(1))).alias("block_no", "text"))
    at = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", "page_id", "block_no")), k, 8), 16, 10).cast("double") / 2**32
    return S.classify_blocks(p.withColumn("x0", at(1) * 0.6).withColumn("y0", at(9) * 0.95).withColumn("x1", F.col("x0") + 0.1 + at(17) * 0.3).withColumn("y1", F.col("y0") + 0.02))


_BLK = """raw AS (SELECT page_id, i - 1 AS block_no, x[i] AS text, md5(page_id || ':' || (i - 1)) AS h FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(?:p|li)>([^<]*)<', 1) AS x FROM pages))),
pos AS (SELECT page_id, block_no, text, cast('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 0.6::DOUBLE AS x0, cast('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE * 0.95::DOUBLE AS y0, cast('0x' || substr(h, 17, 8) AS BIGINT) / 4294967296.0::DOUBLE AS r FROM raw),
box AS (SELECT page_id, block_no, text, x0, y0, x0 + 0.1::DOUBLE + r * 0.3::DOUBLE AS x1, y0 + 0.02::DOUBLE AS y1 FROM pos),
blk AS (SELECT *, CASE WHEN (y0 + y1) / 2 < 0.08::DOUBLE THEN 'page_header' WHEN (y0 + y1) / 2 > 0.92::DOUBLE THEN 'page_footer' WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'table'
  WHEN length(text) < 120 AND regexp_matches(lower(text), 'figure|fig\\.|table|chart|diagram') THEN 'caption' WHEN (y0 + y1) / 2 > 0.75::DOUBLE AND length(text) < 200 AND x1 - x0 < 0.85::DOUBLE THEN 'footnote'
  WHEN x1 - x0 < 0.25::DOUBLE AND (x0 < 0.1::DOUBLE OR x1 > 0.9::DOUBLE) THEN 'sidebar' WHEN length(text) < 80 AND (text = upper(text) OR suffix(text, ':')) THEN 'heading' ELSE 'body' END AS region FROM box),
gp AS (SELECT page_id, (x0 + x1) / 2 AS m, lead((x0 + x1) / 2) OVER (PARTITION BY page_id ORDER BY (x0 + x1) / 2, block_no) AS a FROM blk WHERE region = 'body'),
col AS (SELECT page_id, count(*) >= 4 AND coalesce(bool_or(a - m > 0.15::DOUBLE AND (a + m) / 2 > 0.3::DOUBLE AND (a + m) / 2 < 0.7::DOUBLE), false) AS two FROM gp GROUP BY 1),
cols AS (SELECT DISTINCT page_id, CASE WHEN coalesce(two, false) THEN 2 ELSE 1 END AS columns FROM blk LEFT JOIN col USING (page_id)),
ord AS (SELECT blk.*, columns, row_number() OVER (PARTITION BY page_id ORDER BY region IN ('page_header', 'page_footer'), CASE WHEN columns = 2 AND region = 'body' AND (x0 + x1) / 2 >= 0.5::DOUBLE THEN 1 ELSE 0 END, y0, block_no) - 1 AS place FROM blk JOIN cols USING (page_id))"""


def _b9(s, d):
    p = pages(s, d)
    x = S.sentences(F.col("text"))
    return p.select("doc_id", "page_number", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, "#")).alias("digest"))


def _chunked(s, d):
    return S.chunk_pages(pages(s, d))


def _grouped_lines(s, d):
    """Five lines of a document as one text; in every other document some rows are a table's rule."""
    c = chunks(s, d)
    ruled = F.when((F.col("chunk_index") % 5 == 1) & (F.col("doc_id") % 2 == 0) & F.col("text").rlike(r"^\s*\|"), "|---|---|").otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("chunk_index", ruled.alias("line"))))
    return c.groupBy("doc_id", "lang", F.floor(F.col("chunk_index") / 5).alias("g")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def _a4(s, d):
    p = load(s, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))).withColumn("g", F.col("p_partkey") % 6)
    return S.rows_to_text(p, "p_partkey", "Parts", "g", ["p_size", "p_brand"]).select("g", F.md5("text").alias("digest"))


def _a10(s, d):
    """A store of chunks: filled, a third of it replaced, a fifth deleted."""
    c = chunks(s, d).select("chunk_id", "doc_id", F.length("text").alias("n"))
    store = BucketStore(s, shared_folder(s), "chunk_id string, doc_id long, n int", buckets=32)
    store.upsert(c, ["chunk_id"])
    store.upsert(c.where("doc_id % 3 = 0").withColumn("n", F.lit(0)), ["chunk_id"])
    store.delete(load(s, d, "documents").where("doc_id % 5 = 0"))
    return store.rows().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("length"))


def _a11(s, d):
    store = BucketStore(s, shared_folder(s), "chunk_id string, doc_id long, chunk_index long, text string", buckets=32)
    store.upsert(chunks(s, d), ["chunk_id"])
    wanted = load(s, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("chunk_index"))
    return store.lookup(wanted, ["chunk_index"]).select("chunk_id", "text")


def _a12(s, d):
    """Words of texts by two runs with one cache: a third of the documents, then all of them."""
    x = load(s, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("sha"), (F.col("doc_id") % 2).alias("fingerprint"))
    path, keys = shared_folder(s), ["sha", "fingerprint"]
    for n, part in ((1, x.where("doc_id % 3 = 0")), (2, x)):
        found = worked_out(part, path, keys, lambda rows, n=n: rows.select(*keys, X.word_count(F.col("text")).cast("long").alias("words"), F.lit(n).alias("run")), "sha string, fingerprint long, words long, run int")
    return x.join(found, keys).select("doc_id", "words", "run")


def _stream(f, mode):
    return lambda s, d: L.drained(f(L.event_stream(s, d)), mode)


def _moves(s, d):
    """Users as documents that move between seven batches and five states."""
    return L.event_stream(s, d).select(F.col("user_id").alias("document_id"), (F.col("event_id") % 7).alias("batch_id"), F.col("event_type").alias("status"), "ts")


def _l1_feed(s, d):
    """Two feeds into one store: the documents with even numbers, then the others."""
    store, schema = shared_folder(s), load(s, d, "documents").schema
    for name, half in (("even", 0), ("odd", 1)):
        files = s.readStream.schema(schema).parquet(f"{d}/document[s].parquet").where(F.col("doc_id") % 2 == half)
        key = F.lpad(F.col("doc_id").cast("string"), 12, "0")
        L.feed(files.select(key.alias("id"), key.alias("source_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), name, store, shared_folder(s))
    return L.documents_of(s, store).select("id", "status", "duplicate_of")


def _l2_scores(s, d):
    """Views and their scores, which two thirds of them get, some of these too late."""
    e = L.event_stream(s, d)
    scores = L.event_stream(s, d).where("event_id % 3 > 0").select(F.col("event_id").alias("trace_id"), (F.col("ts") + F.make_dt_interval(mins=F.col("event_id") % 90)).alias("ts"), F.round("value", 2).alias("confidence"))
    rows = L.drained(L.late_scores(e.where("event_type = 'view'").select(F.col("event_id").alias("trace_id"), "ts"), scores), "append")
    return rows.select("trace_id", "confidence")


_SCORES = """WITH s AS (SELECT event_id, ts + to_minutes(event_id % 90) AS ts, round(value, 2) AS confidence FROM events WHERE event_id % 3 > 0),
w AS (SELECT least((SELECT max(ts) FROM events WHERE event_type = 'view'), (SELECT max(ts) FROM s)) - INTERVAL 10 MINUTE AS mark)
SELECT e.event_id AS trace_id, CASE WHEN e.event_id % 90 <= 60 THEN confidence END AS confidence FROM events e LEFT JOIN s USING (event_id), w
WHERE event_type = 'view' AND (s.event_id IS NOT NULL AND e.event_id % 90 <= 60 OR e.ts + INTERVAL 1 HOUR < mark)"""


_round = lambda df, *c: df.select(*[F.round(x, 4).alias(x) if x in c else F.col(x) for x in df.columns])
QUERIES = {
    "a4_rows_to_text": (
        _a4,
        "WITH p AS (SELECT p_partkey % 6 AS g, p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'p_size: ' || p_size END AS a, CASE WHEN p_partkey % 7 <> 0 THEN 'p_brand: ' || p_brand END AS b FROM part), r AS (SELECT g, concat_ws(' | ', a, b) AS c, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS i FROM p WHERE a IS NOT NULL OR b IS NOT NULL) SELECT g, md5('Sheet: Parts' || chr(10) || 'Columns: p_size, p_brand' || chr(10) || string_agg('Row ' || i || ': ' || c, chr(10) ORDER BY i)) AS digest FROM r GROUP BY g",
    ),
    "a10_chunk_store": (_a10, f"SELECT doc_id, count(*) AS chunks, cast(sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS length FROM {CHUNKS} WHERE doc_id % 5 <> 0 GROUP BY 1"),
    "a11_lookup": (_a11, f"SELECT chunk_id, text FROM {CHUNKS} WHERE chunk_index = doc_id % 4"),
    "a12_pending": (
        _a12,
        f"SELECT doc_id, cast({_N('text')} AS BIGINT) AS words, CASE WHEN EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 3 = 0 AND x.text = d.text AND x.doc_id % 2 = d.doc_id % 2) THEN 1 ELSE 2 END AS run FROM documents d WHERE text IS NOT NULL",
    ),
    "b4_sections": (
        lambda s, d: S.sections(_paragraphs(s, d)).select("doc_id", "section", "heading", F.md5("text").alias("digest")),
        f"WITH p AS (SELECT doc_id, chunk_index, text, length(text) < 60 AS h FROM {CHUNKS}), q AS (SELECT *, sum(cast(h AS INTEGER)) OVER w + 1 - first_value(cast(h AS INTEGER)) OVER w AS section FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)) SELECT doc_id, section, max(text) FILTER (h) AS heading, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS digest FROM q GROUP BY doc_id, section",
    ),
    "b5_regions": (lambda s, d: _blocks(s, d).groupBy("page_id", "region").agg(F.count(F.lit(1)).alias("n")), f"WITH {_BLK} SELECT page_id, region, count(*) AS n FROM blk GROUP BY ALL".replace("\\\\", "\\")),
    "b6_columns": (lambda s, d: S.column_count(_blocks(s, d)), f"WITH {_BLK} SELECT * FROM cols".replace("\\\\", "\\")),
    "b7_reading_order": (lambda s, d: S.page_text(S.reading_order(_blocks(s, d))).select("page_id", F.md5("text").alias("digest")), f"WITH {_BLK} SELECT page_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY place)) AS digest FROM ord GROUP BY 1".replace("\\\\", "\\")),
    "b8_page_offsets": (lambda s, d: S.page_offsets(pages(s, d)).select("doc_id", "page_number", "offset"), f"SELECT doc_id, page_number, cast(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM {PAGES}"),
    "b9_sentences": (
        _b9,
        rf"SELECT doc_id, page_number, len(x) AS n, md5(array_to_string(x, '#')) AS digest FROM (SELECT doc_id, page_number, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S')) AS x FROM {PAGES})",
    ),
    "b12_chunks": (_chunked, None),
    "b14_chunk_statistics": (
        lambda s, d: S.chunk_stats(_grouped_lines(s, d), "lang"),
        rf"""SELECT lang, count(*) AS chunks, cast(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n < 48) AS small, count(*) FILTER (opens AND NOT headed) AS bare_openings, count(*) FILTER (opens OR ends) AS row_edges
  FROM (SELECT lang, {_N('text')} AS n, regexp_matches(x[1], '^\s*\|.*\|\s*$') AS opens, regexp_matches(x[-1], '^\s*\|.*\|\s*$') AS ends, list_bool_or(list_transform(x[:3], lambda y: regexp_matches(y, '^\s*\|[\s:|-]*-{{3,}}[\s:|-]*\|\s*$'))) AS headed
    FROM (SELECT lang, string_agg(text, chr(10) ORDER BY chunk_index) AS text, string_split(string_agg(text, chr(10) ORDER BY chunk_index), chr(10)) AS x
      FROM (SELECT doc_id, lang, chunk_index, CASE WHEN chunk_index % 5 = 1 AND doc_id % 2 = 0 AND regexp_matches(text, '^\s*\|') THEN '|---|---|' ELSE text END AS text FROM {CHUNKS}) GROUP BY doc_id, lang, chunk_index // 5)) GROUP BY 1""",
    ),
    "g1_intent": (
        _g1,
        "SELECT conv_id, turn, CASE WHEN NOT lib THEN 'rag' WHEN conv_id % 4 = 1 OR ask THEN 'compound' ELSE 'library' END AS intent, CASE WHEN NOT lib THEN 1.0 WHEN conv_id % 4 = 1 OR ask THEN 0.9 ELSE 0.95 END AS confidence FROM (SELECT conv_id, turn, conv_id % 4 <> 2 AS lib, regexp_matches(lower(text), ' (about|regarding|related to|on the topic of|concerning|and|also|plus|as well as) ') OR regexp_matches(lower(text), '^(and|also|plus) ') AS ask FROM conversations)",
    ),
    "g2_context": (_g2, "WITH " + _G2),
    "g3_recent_turns": (lambda s, d: G.recent_turns(_turns(s, d)).select("session_id", "turn_number", "answer", "place"), f"WITH {_T}, r AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) <= 5) SELECT session_id, turn_number, substr(answer, 1, 500) AS answer, row_number() OVER (PARTITION BY session_id ORDER BY turn_number) - 1 AS place FROM r"),
    "g4_session_list": (lambda s, d: G.session_summaries(_sessions(s, d), _turns(s, d)), f"WITH {_T} SELECT session_id, count(*) AS turns, cast(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, max(ts) AS changed FROM t GROUP BY 1"),
    "g5_compact": (lambda s, d: G.clear(G.compact(_turns(s, d)), _sessions(s, d).where("session_id % 4 = 0")).select("session_id", "turn_number"), f"WITH {_T} SELECT session_id, turn_number FROM t WHERE session_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) <= 2"),
    "g6_scope": (_g6, "SELECT event_id, CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_id % 4 || ',' || event_id % 3 WHEN event_id % 5 = 0 THEN cast(event_id % 3 AS VARCHAR) WHEN event_id % 4 = event_id % 3 THEN event_id % 4 || ',' || event_id % 3 ELSE cast(event_id % 3 AS VARCHAR) END AS ids FROM events"),
    "g7_routing": (_g7, "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'library' WHEN 3 THEN 'compound' ELSE 'retrieval' END AS mode, CASE event_id % 4 WHEN 1 THEN 'q' || event_id ELSE event_type END AS query FROM events"),
    "g8_memory_update": (_g8, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 's' || event_id END AS summary, CASE WHEN event_id % 3 = 0 THEN 'o|x|1' ELSE 'f|x|' || event_id % 5 + 1 END AS facts FROM events".replace("|| event_id % 5 + 1", "|| (event_id % 5 + 1)")),
    "g9_merged_answer": (lambda s, d: _turns(s, d).select("session_id", "turn_number", F.md5(G.merged_answer(F.when(F.col("turn_number") % 4 == 0, F.lit("")).otherwise(F.col("user_query")), F.col("answer"))).alias("digest")), f"WITH {_T} SELECT session_id, turn_number, md5(CASE WHEN turn_number % 4 = 0 THEN answer ELSE user_query || chr(10) || chr(10) || answer END) AS digest FROM t"),
    "g10_file_list": (_g10, r"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN rtrim(text || ' ', ' ') || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || 'and  end' WHEN 1 THEN rtrim(text || ' ', ' ') || chr(10) || chr(10) || '- a' || chr(10) || '- b' WHEN 2 THEN '- a' || chr(10) || '- b' ELSE text END AS answer FROM conversations"),
    "g11_appended_turns": (_g11, f"WITH {_T}, m AS (SELECT session_id, max(turn_number) AS m FROM t GROUP BY 1) SELECT session_id, turn_number, md5(user_query) AS q FROM t UNION ALL SELECT session_id, m + row_number() OVER (PARTITION BY session_id ORDER BY turn_number), md5('again ' || user_query) FROM t JOIN m USING (session_id) WHERE turn_number < 4"),
    "g12_expired_logins": (_g12, "SELECT user_id AS id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' OR user_id % 60 < 30"),
    "g13_outcome": (_g13, "SELECT event_id, event_id % 3 <> 0 AND NOT f AS used_rag, event_id % 3 < 2 OR f AS used_library, event_id % 3 <> 0 AND NOT f AND event_id % 2 > 0 AS used_graph FROM (SELECT event_id, event_id % 3 = 2 AND event_id % 2 = 0 AND event_id % 5 = 0 AS f FROM events)"),
    "l1_fresh_documents": (_stream(lambda e: L.fresh_documents(e.select("ts", F.col("user_id").alias("hash")), "60 days").select("hash", "status"), "append"), "SELECT DISTINCT user_id AS hash, 'pending' AS status FROM events"),
    "l1_ingest_feed": (
        _l1_feed,
        """WITH f AS (SELECT doc_id, text, doc_id % 2 AS half FROM documents), g AS (SELECT *, min(CASE WHEN half = 0 THEN lpad(doc_id::VARCHAR, 12, '0') END) OVER (PARTITION BY text) AS before, min(lpad(doc_id::VARCHAR, 12, '0')) OVER (PARTITION BY text, half) AS same FROM f),
  h AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, CASE WHEN half = 0 THEN same ELSE coalesce(before, same) END AS first FROM g) SELECT id, CASE WHEN id = first THEN 'pending' ELSE 'skipped_duplicate' END AS status, CASE WHEN id <> first THEN first END AS duplicate_of FROM h""",
    ),
    "l2_status_counts": (
        lambda s, d: L.drained(L.status_changes(_moves(s, d)), "append").groupBy("batch_id", "status").agg(F.sum("change").alias("n")).where("n <> 0"),
        "SELECT batch_id, status, count(*) AS n FROM (SELECT user_id, arg_max(event_id % 7, {'t': ts, 's': event_type}) AS batch_id, arg_max(event_type, {'t': ts, 's': event_type}) AS status FROM events GROUP BY 1) GROUP BY ALL",
    ),
    "l2_event_counts": (_stream(lambda e: L.status_counts(e, "user_id", "event_type"), "complete"), "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "l2_late_scores": (_l2_scores, _SCORES),
    "l3_throughput": (
        lambda s, d: _round(L.drained(L.throughput(L.event_stream(s, d), 100), "complete"), "per_minute", "minutes_left"),
        "SELECT w AS start, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(count(*) / 5.0, 4) END AS per_minute, CASE WHEN count(*) >= 2 THEN round(500.0 / count(*), 4) END AS minutes_left FROM (SELECT date_trunc('minute', ts) - to_minutes(k) AS w FROM events, range(5) r(k)) GROUP BY 1",
    ),
    "l4_session_activity": (
        lambda s, d: L.drained(L.session_activity(L.event_stream(s, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("tokens"))), "complete"),
        "WITH x AS (SELECT user_id AS key, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts) AS g FROM x) SELECT key, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS turns, cast(sum(event_id) AS BIGINT) AS tokens FROM y GROUP BY key, g",
    ),
    "l5_session_memory": (
        lambda s, d: L.drained(L.session_memory(L.event_stream(s, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("turn"), F.lit(2).cast("long").alias("tokens"))), "update").select("key", F.array_join(F.col("last_turns").cast("array<string>"), ",").alias("last_turns"), "tokens", "expired"),
        """WITH x AS (SELECT user_id AS key, ts, event_id, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER w) < 43200000 THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, event_id) AS g FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r, max(g) OVER (PARTITION BY key) AS last FROM y),
  m AS (SELECT key, string_agg(event_id, ',' ORDER BY ts, event_id) FILTER (r <= 5) AS last_turns, 2 * count(*) AS tokens, max(ts) AS ts FROM z WHERE g = last GROUP BY 1)
  SELECT key, last_turns, tokens, false AS expired FROM m UNION ALL SELECT key, last_turns, tokens, true FROM m WHERE ts + INTERVAL 12 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    ),
    "l6_stage_latency": (
        lambda s, d: _round(L.drained(L.stage_latency(L.event_stream(s, d).select("ts", F.col("event_type").alias("stage"), F.col("value").alias("ms"))), "complete"), "mean", "median"),
        "SELECT date_trunc('hour', ts) AS start, event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_disc(value, 0.5), 4) AS median FROM events GROUP BY ALL",
    ),
}
