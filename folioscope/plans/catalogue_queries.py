"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import catalogue as K
from folioscope.operators.edits import replay
from folioscope.operators.retrieval import ranked
from folioscope.plans.tables import CATALOGUE, catalogue, load


def _h5(s, d):
    c = catalogue(s, d)
    return K.mark_duplicates(c.where("n % 2 = 0").select("id", "file_hash", (F.col("n") % 10 == 0).alias("is_version")), c.where("n % 2 = 1")).select("id", "status")


def _h6(s, d):
    return K.version_history(catalogue(s, d).withColumn("id", F.lpad("id", 9, "0")), "family").select("id", "place", "next_version")


def _h8(s, d):
    c = catalogue(s, d)
    b = K.batch_status(c).withColumn("status", F.when(F.substring("batch_id", -1, 1) == "4", "completed").otherwise(F.col("status")))
    return K.requeue(c, b).select("id", "batch_id", "status")


def _h9(s, d):
    c = catalogue(s, d)
    i = F.col("query_id")
    q = load(s, d, "benchmark").select(F.col("item_id").alias("query_id"))
    text = F.when(i % 5 == 0, F.concat(F.lit("Show me DOC_"), i * 3, F.lit(".txt now"))).when(i % 5 == 1, F.concat(F.lit("what does 'oc_"), i, F.lit(".tx' say"))).when(i % 5 == 2, F.lit("the second document please")).when(i % 5 == 3, F.lit("the doc")).otherwise(F.lit("a b c"))
    return K.resolve_documents(q.select("query_id", text.alias("question")), c)


def _placed(s, d):
    rows = K.explorer(catalogue(s, d))
    return rows, rows.where("n % 17 = 0").select("id", F.lit("moved").alias("root"), F.concat("lang", F.lit("/deep/9")).alias("folder"))


def _h12(s, d):
    c = catalogue(s, d)
    folders = c.select("lang", "source").distinct().select(F.lit("r").alias("root"), F.concat_ws("/", "lang", "source").alias("path")).unionByName(c.select(F.lit("r").alias("root"), F.col("lang").alias("path")).distinct())
    placements = c.where("n % 40 = 3").select(F.lit("r").alias("root"), F.concat_ws("/", "lang", "source").alias("folder"))
    return K.deletable(folders, placements)


_FOLDERS = ("a", "a/b", "a/b/c", "a/d", "e", "e/f", "g", "")


def _edits(s, d):
    """Edits by event: of 3 roots, 8 paths, and a document for each user; half of them on folders."""
    e = load(s, d, "events")
    i = F.col("event_id")
    mixed = F.conv(F.substring(F.md5(i.cast("string")), 1, 8), 16, 10).cast("long")
    kind = F.get(F.array(*map(F.lit, ("create", "remove", "create", "remove", "place", "clear", "clear", "delete"))), (mixed % 8).cast("int"))
    root = F.concat(F.lit("r"), (mixed / 64).cast("long") % 3)
    return e.select(i.alias("seq"), kind.alias("kind"), root.alias("root"), F.get(F.array(*map(F.lit, _FOLDERS)), ((mixed / 1024).cast("long") % 8).cast("int")).alias("path"), F.col("user_id").alias("document_id"))


def _edits_sql(t="events"):
    paths = "[" + ", ".join(f"'{p}'" for p in _FOLDERS) + "]"
    return f"""m AS (SELECT event_id, user_id, cast('0x' || substr(md5(event_id::VARCHAR), 1, 8) AS BIGINT) AS x FROM {t}),
ed AS (SELECT event_id AS seq, ['create', 'remove', 'create', 'remove', 'place', 'clear', 'clear', 'delete'][x % 8 + 1] AS kind, 'r' || x // 64 % 3 AS root, {paths}[x // 1024 % 8 + 1] AS path, user_id AS document_id FROM m)"""


def _h12_replay(s, d):
    """What became of each edit; and the folders and placements that are left, without a number."""
    e = _edits(s, d)
    outcomes, folders, placements, _ = replay(e, e.where("false").select("root", "path"), e.where("false").select("document_id", "root", "path"))
    left = folders.select(F.lit(None).cast("long").alias("seq"), F.concat_ws(":", F.lit("folder"), "root", "path").alias("outcome"))
    return outcomes.unionByName(left).unionByName(placements.select(F.lit(None).cast("long").alias("seq"), F.concat_ws(":", F.lit("document"), "document_id", "root", "path").alias("outcome")))


_REPLAY = f"""WITH RECURSIVE {_edits_sql()},
own AS (SELECT *, lag(kind) OVER w AS was, lead(seq) OVER w AS until FROM ed WHERE kind IN ('place', 'clear', 'delete') WINDOW w AS (PARTITION BY document_id ORDER BY seq)),
rem AS (SELECT e.*, EXISTS (SELECT 1 FROM own o WHERE o.kind = 'place' AND o.root = e.root AND (o.path = e.path OR starts_with(o.path, e.path || '/')) AND o.seq < e.seq AND (o.until IS NULL OR o.until > e.seq)) AS used,
  row_number() OVER (PARTITION BY root ORDER BY seq) AS n FROM ed e WHERE kind IN ('create', 'remove')),
fold AS (
  SELECT root, 0::BIGINT AS n, -1::BIGINT AS seq, [] ::VARCHAR[] AS folders, '' AS outcome FROM (SELECT DISTINCT root FROM rem)
  UNION ALL
  SELECT root, n, seq, CASE outcome WHEN 'created' THEN list_append(folders, path) WHEN 'removed' THEN list_filter(folders, lambda f: f <> path) ELSE folders END, outcome FROM (
    SELECT r.root, r.n, r.seq, r.path, f.folders, CASE WHEN r.kind = 'create' THEN CASE WHEN list_contains(f.folders, r.path) THEN 'exists' ELSE 'created' END
      WHEN NOT list_contains(f.folders, r.path) THEN 'absent' WHEN r.used OR len(list_filter(f.folders, lambda y: starts_with(y, r.path || '/'))) > 0 THEN 'blocked' ELSE 'removed' END AS outcome
    FROM fold f JOIN rem r ON r.root = f.root AND r.n = f.n + 1)
)
SELECT seq, outcome FROM fold WHERE n > 0
UNION ALL SELECT seq, CASE WHEN kind = 'place' THEN CASE WHEN was = 'place' THEN 'moved' ELSE 'placed' END WHEN was = 'place' THEN CASE kind WHEN 'clear' THEN 'cleared' ELSE 'deleted' END ELSE 'nothing' END FROM own
UNION ALL SELECT NULL, 'folder:' || root || ':' || unnest(folders) FROM fold f WHERE n = (SELECT max(n) FROM fold g WHERE g.root = f.root)
UNION ALL SELECT NULL, 'document:' || document_id || ':' || root || ':' || path FROM own WHERE kind = 'place' AND until IS NULL"""


def _aces(s, d):
    o = load(s, d, "lineitem")
    everyone = (F.col("l_linenumber") == 7) | (F.col("l_partkey") % 50 == 0)
    sid = F.when(everyone, F.lit("S-1-1-0")).when(F.col("l_partkey") % 9 == 0, F.lit("S-1-5-21-1")).otherwise(F.concat(F.lit("S-1-12-1-"), F.col("l_suppkey") % 5, F.lit("-0-0-0")))
    return o.select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", "deny").otherwise("allow").alias("ace_type"), F.when(F.col("l_linenumber") == 3, 8).otherwise(0).alias("flags"), F.when(F.col("l_linenumber") == 5, 2).otherwise(1).alias("mask"), sid.alias("sid"))


_ACE = """ace AS (SELECT l_orderkey AS document_id, CASE WHEN l_returnflag = 'R' THEN 'deny' ELSE 'allow' END AS t, CASE WHEN l_linenumber = 7 OR l_partkey % 50 = 0 THEN '*' WHEN l_partkey % 9 <> 0 THEN '0000000' || l_suppkey % 5 || '-0000-0000-0000-000000000000' END AS who,
  l_linenumber NOT IN (3, 5) AS used FROM lineitem),
acl AS (SELECT document_id, coalesce(bool_or(t = 'allow' AND who = '*') FILTER (used), false) AND NOT coalesce(bool_or(t = 'deny' AND who = '*') FILTER (used), false) AS allow_all,
  coalesce(list_sort(list(DISTINCT who) FILTER (used AND t = 'deny' AND who IS NOT NULL)), []) AS denied, coalesce(list_sort(list(DISTINCT who) FILTER (used AND t = 'allow' AND who IS NOT NULL AND who <> '*')), []) AS a, count(*) FILTER (used AND who IS NULL) AS unresolved FROM ace GROUP BY 1),
acl2 AS (SELECT document_id, allow_all, CASE WHEN list_contains(denied, '*') THEN [] ELSE list_filter(a, lambda x: NOT list_contains(denied, x)) END AS principals, denied, unresolved FROM acl)"""


def _acl(s, d):
    return K.evaluate_aces(_aces(s, d))


def _h13(s, d):
    return _acl(s, d).select("document_id", "allow_all", F.array_join("principals", ",").alias("principals"), F.array_join("denied", ",").alias("denied"), "unresolved")


def _access(s, d):
    who = lambda k: F.concat(F.lit("0000000"), (F.col("n_nationkey") % k).cast("string"), F.lit("-0000-0000-0000-000000000000"))
    users = load(s, d, "nation").select(F.concat(F.lit("u"), "n_nationkey").alias("user_id"), F.array(who(5), who(4)).alias("groups"))
    i = F.col("document_id")
    acl = _acl(s, d).withColumn("status", F.when(i % 7 == 0, "error").otherwise("ok")).withColumn("last_ok_at", F.when(i % 11 != 0, F.timestamp_seconds(F.lit(1704067200) + i % 20 * 86400)))
    return K.access(users, acl, F.timestamp_seconds(F.lit(1704067200 + 20 * 86400)))


_ACCESS = f"""{_ACE}, usr AS (SELECT 'u' || n_nationkey AS user_id, ['0000000' || n_nationkey % 5 || '-0000-0000-0000-000000000000', '0000000' || n_nationkey % 4 || '-0000-0000-0000-000000000000'] AS g FROM nation),
acc AS (SELECT user_id, document_id FROM acl2, usr WHERE document_id % 7 <> 0 AND document_id % 11 <> 0 AND document_id % 20 >= 13 AND NOT list_contains(denied, '*') AND len(list_intersect(denied, g)) = 0 AND (allow_all OR len(list_intersect(principals, g)) > 0))"""


def _h4(s, d):
    acc = _access(s, d).withColumn("document_id", F.col("document_id").cast("string"))
    src = catalogue(s, d).select(F.concat(F.lit("a"), "id").alias("answer_id"), F.col("id").alias("document_id"), F.concat(F.lit("u"), F.col("n") % 25).alias("user_id"))
    return K.enrich_sources(src, catalogue(s, d), acc).select("answer_id", "document_id", "source_path")


def _h15(s, d):
    docs = catalogue(s, d)
    acc = _access(s, d).select("user_id", F.col("document_id").cast("string").alias("id"))
    return K.visible_roots(docs.select("id", F.col("lang").alias("root")), acc)


def _manifest(s, d):
    c = catalogue(s, d)
    files = c.select(F.concat("source_path", F.lit("")).alias("path"), F.col("page_count").alias("pages"), (F.col("n") * 10).alias("size_bytes"), F.col("file_hash").alias("sha256"))
    log = load(s, d, "pages").join(load(s, d, "documents"), F.col("page_id") == F.col("doc_id")).select(F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"), "url", "page_id")
    golden = load(s, d, "benchmark").select(F.concat(F.lit("g"), "item_id").alias("id"), F.array(F.concat(F.lit("doc_"), "item_id", F.lit(".txt")), F.concat(F.lit("doc_"), F.col("item_id") * 2, F.lit(".txt"))).alias("sources"))
    known = files.select("path", F.concat(F.lit("http://mirror.example/"), "path").alias("source_url")).where(F.length("path") % 4 == 0)
    return K.build_manifest(files, log.where("page_id % 3 > 0"), golden, known)


_M = f"""gold AS (SELECT b, string_agg(DISTINCT id, ' ' ORDER BY id) AS ids FROM (SELECT 'g' || item_id AS id, unnest(['doc_' || item_id || '.txt', 'doc_' || item_id * 2 || '.txt']) AS b FROM benchmark) GROUP BY 1),
man AS (SELECT source_path AS path, page_count AS pages, n * 10 AS size_bytes, file_hash AS sha256, coalesce(nullif(url, ''), CASE WHEN length(source_path) % 4 = 0 THEN 'http://mirror.example/' || source_path END, '') AS source_url, coalesce(ids, '') AS golden_questions, lang, source, n
  FROM {CATALOGUE} c LEFT JOIN pages ON page_id = n AND page_id % 3 > 0 LEFT JOIN gold ON b = 'doc_' || id || '.txt')"""


def _h18(s, d):
    m = _manifest(s, d)
    k = F.length("path") + F.col("pages")
    inv = m.where(k % 3 != 0).select("path", F.when(k % 3 == 1, F.col("sha256")).otherwise(F.lit("x")).alias("have"))
    return K.fetch_status(m, inv).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _h19(s, d):
    o = load(s, d, "orders")
    i = F.col("o_orderkey")
    acl = o.where("o_orderkey % 3 <> 0").select(i.alias("document_id"), F.lit("ok").alias("status"), F.array(F.lit("old")).alias("principals"), F.lit(1).alias("crawled_at"), F.lit(1).alias("last_ok_at"))
    crawl = o.where("o_orderkey % 2 = 0").select(i.alias("document_id"), F.when(i % 4 == 0, "ok").otherwise("denied").alias("status"), F.array(F.lit("new")).alias("principals"), F.lit(2).alias("crawled_at"))
    return K.acl_upsert(acl, crawl).select("document_id", "status", F.array_join("principals", ",").alias("principals"), "crawled_at", "last_ok_at")


def _h16_listing(s, d):
    """Two thirds of the documents are in one of four product families of their vendor."""
    c = catalogue(s, d)
    return K.vendor_listing(c.select(F.concat_ws("/", "lang", "source", F.when(F.col("n") % 3 > 0, F.concat(F.lit("f"), F.col("n") % 4)), "id").alias("path"), F.col("page_count").alias("pages")))


def _crawled(s, d):
    """Orders as crawled documents; some have no path, some fail in one of three ways, some have identifiers that nobody knows."""
    o, i = load(s, d, "orders"), F.col("o_orderkey")
    error = F.when(i % 7 == 0, "Error: ACCESS was Denied").when(i % 11 == 0, "timed out").when(i % 13 == 0, "bad entry")
    rows = o.select(i.alias("document_id"), F.when(i % 29 == 0, " ").otherwise(F.concat(F.lit("/o/"), i)).alias("path"), error.alias("error"), F.when(i % 13 == 0, "parse").otherwise("read").alias("stage"), F.col("o_orderdate").cast("string").alias("crawled_at"), F.when(i % 5 == 0, F.array((i % 90).cast("string"))).otherwise(F.array().cast("array<string>")).alias("unresolved"))
    return rows.withColumn("status", K.crawl_status(F.col("path"), F.col("error"), F.col("stage")))


_CRAWL = """cr AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 29 = 0 THEN ' ' ELSE '/o/' || o_orderkey END AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'Error: ACCESS was Denied' WHEN o_orderkey % 11 = 0 THEN 'timed out' WHEN o_orderkey % 13 = 0 THEN 'bad entry' END AS error,
  CASE WHEN o_orderkey % 29 = 0 THEN 'blank_path' WHEN o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 THEN 'ok' WHEN o_orderkey % 13 = 0 THEN 'parse_error' WHEN o_orderkey % 7 = 0 THEN 'access_denied' ELSE 'unreachable' END AS status, cast(o_orderdate AS VARCHAR) AS crawled_at FROM orders)"""


def _h20(s, d):
    e = load(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    fresh = F.col("ts").cast("timestamp") >= F.timestamp_seconds(F.lit(1704067200 + 29 * 86400))
    return e.select("user_id", F.when(fresh, "use").otherwise("empty").alias("cache"))


def _nodes(s, d):
    c = catalogue(s, d)
    return c.select(F.lit("r").alias("root"), F.concat_ws("/", "lang", "source").alias("path"), "id").unionByName(c.select(F.lit("r").alias("root"), F.col("lang").alias("path"), "id"))


def _h21(s, d):
    c = catalogue(s, d)
    return K.selection_state(_nodes(s, d), c.where("source IN ('src1', 'src2') OR lang = 'fr'"))


_R = lambda ctes, body: f"WITH {ctes} {body}"
_BATCH = f"""(SELECT batch_id, total, completed, failed, parsing, chunking, embedding, CASE WHEN completed + failed = total THEN CASE WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END ELSE 'processing' END AS status,
  CASE WHEN completed + failed = total THEN 100 ELSE least(99, p // total) END AS progress FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'ready') AS completed, count(*) FILTER (status = 'error') AS failed,
  count(*) FILTER (status = 'processing' AND stage = 'parsing') AS parsing, count(*) FILTER (status = 'processing' AND stage = 'chunking') AS chunking, count(*) FILTER (status = 'processing' AND stage = 'embedding') AS embedding,
  sum(CASE WHEN status = 'processing' THEN CASE stage WHEN 'parsing' THEN 20 WHEN 'chunking' THEN 50 ELSE 75 END ELSE 100 END)::BIGINT AS p FROM {CATALOGUE} GROUP BY 1))"""
QUERIES = {
    "h1_library_summary": (lambda s, d: K.library_summary(catalogue(s, d)), f"SELECT source AS category, count(*) AS documents, sum(page_count)::BIGINT AS pages, sum(chunk_count)::BIGINT AS chunks FROM {CATALOGUE} WHERE status = 'ready' GROUP BY ROLLUP (source)"),
    "h2_library_listing": (lambda s, d: K.library_listing(catalogue(s, d)), f"SELECT source AS category, string_agg('- ' || source_path || ' (' || page_count || ' pages)', chr(10) ORDER BY source_path) AS listing FROM {CATALOGUE} WHERE status = 'ready' GROUP BY 1"),
    "h3_ready_documents": (lambda s, d: ranked(catalogue(s, d).where("status = 'ready'"), ["batch_id"], F.desc("upload_date"), F.col("id")).select("id", "batch_id", "rank", "page_count"), f"SELECT id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY upload_date DESC, id) - 1 AS rank, page_count FROM {CATALOGUE} WHERE status = 'ready'"),
    "h4_enriched_sources": (_h4, _R(_ACCESS, f"SELECT 'a' || id AS answer_id, id AS document_id, CASE WHEN user_id IS NOT NULL THEN source_path ELSE '' END AS source_path FROM {CATALOGUE} LEFT JOIN acc ON document_id = n AND user_id = 'u' || n % 25")),
    "h5_duplicates": (_h5, f"SELECT id, CASE WHEN n % 10 <> 0 AND (row_number() OVER (PARTITION BY file_hash ORDER BY id) > 1 OR file_hash IN (SELECT file_hash FROM {CATALOGUE} WHERE n % 2 = 1 AND status = 'ready')) THEN 'skipped_duplicate' ELSE 'pending' END AS status FROM {CATALOGUE} WHERE n % 2 = 0"),
    "h6_version_history": (_h6, f"SELECT lpad(id, 9, '0') AS id, row_number() OVER (PARTITION BY family ORDER BY version DESC, lpad(id, 9, '0') DESC) - 1 AS place, max(version) OVER (PARTITION BY family) + 1 AS next_version FROM {CATALOGUE}"),
    "h6_latest_versions": (lambda s, d: K.latest_versions(catalogue(s, d), "family").select("family", "version"), f"SELECT family, max(version) AS version FROM {CATALOGUE} WHERE status = 'ready' GROUP BY 1"),
    "h7_batch_status": (lambda s, d: K.batch_status(catalogue(s, d)), f"SELECT * FROM {_BATCH}"),
    "h8_requeue": (_h8, f"SELECT id, c.batch_id, 'pending' AS status FROM {CATALOGUE} c JOIN {_BATCH} b ON b.batch_id = c.batch_id WHERE c.status = 'processing' AND b.status = 'processing' AND c.batch_id NOT LIKE '%4'"),
    "h9_resolved_documents": (
        _h9,
        f"""WITH dd AS (SELECT id, 'doc_' || id || '.txt' AS b, lower(filename) AS f, row_number() OVER (ORDER BY 'doc_' || id || '.txt', id) AS i FROM {CATALOGUE} WHERE status = 'ready')
        SELECT item_id AS query_id, 1 AS rule, id AS document_id FROM benchmark JOIN dd ON item_id % 5 = 0 AND contains('show me doc_' || item_id * 3 || '.txt now', b)
        UNION ALL SELECT item_id, 2, id FROM benchmark JOIN dd ON item_id % 5 = 1 AND contains(f, 'oc_' || item_id || '.tx') UNION ALL SELECT item_id, 3, id FROM benchmark JOIN dd ON item_id % 5 = 2 AND i = 2""",
    ),
    "h10_explorer": (
        lambda s, d: K.explorer(catalogue(s, d)).select("id", "root", "folder", "duplicate_of"),
        f"SELECT c.id, 'Upload ' || strftime(min(upload_date) OVER (PARTITION BY batch_id), '%Y-%m-%d') || ' · ' || batch_id AS root, lang || '/' || source AS folder, CASE WHEN o.id <> c.id THEN o.id END AS duplicate_of FROM {CATALOGUE} c LEFT JOIN (SELECT file_hash, arg_min(id, upload_date) AS id FROM {CATALOGUE} WHERE status = 'ready' GROUP BY 1) o ON o.file_hash = c.file_hash",
    ),
    "h11_folder_tree": (
        lambda s, d: K.folder_tree(*_placed(s, d)),
        f"""WITH p AS (SELECT id, status, CASE WHEN n % 17 = 0 THEN 'moved' ELSE 'Upload ' || strftime(min(upload_date) OVER (PARTITION BY batch_id), '%Y-%m-%d') || ' · ' || batch_id END AS root, CASE WHEN n % 17 = 0 THEN [lang, 'deep', '9'] ELSE [lang, source] END AS parts FROM {CATALOGUE}),
        e AS (SELECT id, status, root, array_to_string(parts[1:k], '/') AS path, parts[1:k] AS pp FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS k FROM p))
        SELECT root, path, count(DISTINCT id) AS documents, count(*) FILTER (status = 'processing') AS in_work, array_to_string(list_transform(regexp_extract_all(lower(path), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 12, '0') ELSE x END), '') AS sort_key FROM e GROUP BY root, path""".replace("\\\\", "\\"),
    ),
    "h12_deletable_folders": (_h12, f"WITH f AS (SELECT DISTINCT lang || '/' || source AS path, lang FROM {CATALOGUE}), p AS (SELECT DISTINCT lang || '/' || source AS path FROM {CATALOGUE} WHERE n % 40 = 3) SELECT 'r' AS root, path, path IN (SELECT path FROM p) AS blocked FROM f UNION ALL SELECT DISTINCT 'r', lang, true FROM f"),
    "h12_edit_replay": (_h12_replay, _REPLAY),
    "h13_evaluated_aces": (_h13, _R(_ACE, "SELECT document_id, allow_all, array_to_string(principals, ',') AS principals, array_to_string(denied, ',') AS denied, unresolved FROM acl2")),
    "h14_access": (_access, _R(_ACCESS, "SELECT * FROM acc")),
    "h15_visible_roots": (_h15, _R(_ACCESS, f"SELECT user_id, lang AS root, count(*) AS documents FROM acc JOIN {CATALOGUE} ON n = document_id GROUP BY ALL")),
    "h16_corpus_index": (lambda s, d: K.corpus_index(_manifest(s, d)), _R(_M, "SELECT lang AS category, count(*) AS documents, sum(pages)::BIGINT AS pages, sum(size_bytes)::BIGINT AS size_bytes, count(DISTINCT source) AS vendors, count(*) FILTER (source_url <> '') AS with_url, count(*) FILTER (golden_questions <> '') AS cited FROM man GROUP BY ROLLUP (lang)")),
    "h16_vendor_listing": (
        _h16_listing,
        _R(f"fam AS (SELECT lang AS category, source AS vendor, CASE WHEN n % 3 > 0 THEN 'f' || n % 4 END AS family, page_count AS pages FROM {CATALOGUE})", """SELECT category, vendor, family, count(*) AS documents, sum(pages)::BIGINT AS pages, count(DISTINCT family) AS families, false AS whole FROM fam GROUP BY ALL
  UNION ALL SELECT category, vendor, NULL, count(*), sum(pages)::BIGINT, count(DISTINCT family), true FROM fam GROUP BY ALL UNION ALL SELECT category, NULL, NULL, count(*), sum(pages)::BIGINT, count(DISTINCT family), true FROM fam GROUP BY ALL"""),
    ),
    "h17_manifest": (_manifest, _R(_M, "SELECT path, pages, size_bytes, sha256, source_url, golden_questions FROM man")),
    "h18_fetch_status": (_h18, _R(_M, "SELECT CASE WHEN (length(path) + pages) % 3 = 1 THEN 'present' WHEN (length(path) + pages) % 3 = 2 THEN 'differs' WHEN source_url = '' THEN 'no-url' ELSE 'would-fetch' END AS status, count(*) AS n FROM man GROUP BY 1")),
    "h19_acl_upsert": (_h19, "SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4 <> 0 THEN 'denied' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 3 <> 0 THEN 'old' END AS principals, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS crawled_at, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 3 <> 0 THEN 1 END AS last_ok_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"),
    "h19_crawl_summary": (lambda s, d: K.crawl_summary(_crawled(s, d)), _R(_CRAWL, "SELECT status, count(*) AS documents, NULL::BIGINT AS unresolved, max(crawled_at) AS last_crawl FROM cr GROUP BY 1 UNION ALL SELECT NULL, count(*), (SELECT count(DISTINCT o_orderkey % 90) FROM orders WHERE o_orderkey % 5 = 0), max(crawled_at) FROM cr")),
    "h19_failing": (lambda s, d: K.failing(_crawled(s, d)), _R(_CRAWL, "SELECT document_id, path, status, error FROM cr WHERE status <> 'ok' ORDER BY document_id LIMIT 200")),
    "h21_scope": (lambda s, d: K.scope_of(_nodes(s, d), _nodes(s, d).where("path IN ('fr', 'en/src1', 'de/src2')").select("root", "path")), f"SELECT id FROM {CATALOGUE} WHERE lang = 'fr' OR lang = 'en' AND source = 'src1' OR lang = 'de' AND source = 'src2'"),
    "h20_group_cache": (_h20, "SELECT user_id, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30' THEN 'use' ELSE 'empty' END AS cache FROM events GROUP BY 1"),
    "h21_selection_state": (_h21, f"WITH x AS (SELECT lang || '/' || source AS path, source IN ('src1', 'src2') OR lang = 'fr' AS i FROM {CATALOGUE} UNION ALL SELECT lang, source IN ('src1', 'src2') OR lang = 'fr' FROM {CATALOGUE}) SELECT 'r' AS root, path, CASE WHEN bool_and(i) THEN 'all' WHEN bool_or(i) THEN 'some' ELSE 'none' END AS state FROM x GROUP BY path"),
}
