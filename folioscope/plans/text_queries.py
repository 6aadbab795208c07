"""Queries of the column functions and of headings, tables and digests, over the document and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T  # noqa: F401

from folioscope.functions import text as X
from folioscope.plans.tables import CATALOGUE, CHUNKS, PAGES, catalogue, chunks, load, pages

_WS = r"[ \t\n\x0B\f\r]"
_STOP = "[" + ", ".join(f"'{x}'" for x in X.STOPWORDS) + "]"
_OVERLAP = lambda c: f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 3)), lambda t: NOT list_contains({_STOP}, t))"


def _docs(columns):
    """A query of columns over documents, made when it runs."""
    return lambda spark, d: load(spark, d, "documents").select("doc_id", *columns())


def _a2(spark, d):
    raw = F.concat(F.lit("..\\"), "lang", F.lit("/./"), "source", F.lit("//"), F.col("doc_id"), F.lit(".txt"))
    return load(spark, d, "documents").select("doc_id", X.sanitised_path(F.when(F.col("doc_id") % 50 == 0, F.lit("../..")).otherwise(raw)).alias("path"))


def _c3(spark, d):
    docs = load(spark, d, "documents").select("doc_id", X.overlap_tokens(F.col("text")).alias("t"))
    a, b = docs.alias("a"), docs.alias("b")
    return a.join(b, F.col("a.doc_id") + 1 == F.col("b.doc_id")).select("a.doc_id", F.round(X.overlap_score(F.col("a.t"), F.col("b.t")), 6).alias("score"))


def _c5(spark, d):
    c = chunks(spark, d)
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.chunk_index") + 1 == F.col("b.chunk_index"))).select(
        "a.chunk_id", X.has_row(F.col("a.text")).alias("has_row"), X.continues(F.col("a.text"), F.col("b.text")).alias("continues")
    )


_BAR = lambda c: rf"regexp_matches({c}, '^\s*\|.*\|\s*$')"
_STEP = lambda c: rf"regexp_matches({c}, '^\s*(\(?\d{{1,2}}[.)]|[Ss][Tt][Ee][Pp]\s+\d+|[a-h][.)])\s+\S')"


def _c7(spark, d):
    c = catalogue(spark, d)
    path = F.when(F.col("n") % 7 == 0, F.lit("")).when(F.col("n") % 7 == 1, F.concat(F.lit("top"), "id")).otherwise(F.col("source_path"))
    name = X.display_name(path, F.col("filename"))
    return c.select("id", name.alias("name"), X.category(name).alias("category"))


def _c9(spark, d):
    c = catalogue(spark, d)
    base = F.when(F.col("n") % 3 == 0, F.lit("\\\\host\\share\\")).when(F.col("n") % 3 == 1, F.lit(" /data/in/ ")).otherwise(F.lit(""))
    full = X.join_original_path(base, F.concat(F.lit("/"), "source_path"))
    return c.select("id", full.alias("original_path"), X.upload_root(full, F.col("source_path")).alias("root"), X.folder_path(F.col("source_path")).alias("folder"))


def _c10(spark, d):
    c = catalogue(spark, d)
    raw = F.when(F.col("n") % 4 == 0, F.concat(F.lit("\\\\?\\UNC\\FS1\\Share\\"), "source_path")).when(F.col("n") % 4 == 1, F.concat(F.lit("//Old//Docs/"), "source_path")).when(F.col("n") % 4 == 2, F.lit("\\\\alone")).otherwise(F.col("source_path"))
    return c.select("id", X.canonical_unc(raw, F.create_map(F.lit("old"), F.lit("fs2"))).alias("unc"))


def _sid(k):
    return F.conv(F.substring(F.md5(F.concat("id", F.lit(f":{k}"))), 1, 8), 16, 10)


def _c11(spark, d):
    c = catalogue(spark, d)
    sid = F.when(F.col("n") % 10 == 0, F.lit("S-1-5-11")).when(F.col("n") % 10 == 1, F.lit("S-1-5-21-7-7")).otherwise(F.concat_ws("-", F.lit("S-1-12-1"), *[_sid(k) for k in range(4)]))
    principal = X.sid_to_principal(sid)
    return c.select("id", principal.alias("principal"), F.when(F.length(principal) > 1, X.principal_to_sid(principal) == sid).alias("inverse_holds"))


_HEX4 = lambda k: f"('0x' || substr(md5(id || ':{k}'), 1, 8))::BIGINT"
_BYTES = lambda k: [f"substr(md5(id || ':{k}'), {7 - 2 * j}, 2)" for j in range(4)]  # noqa: E731  # least significant first
_B = [x for k in range(4) for x in _BYTES(k)]
_OID = " || ".join([_B[3], _B[2], _B[1], _B[0], "'-'", _B[5], _B[4], "'-'", _B[7], _B[6], "'-'", _B[8], _B[9], "'-'", *_B[10:16]])


def _c12(spark, d):
    p = load(spark, d, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("&x-sign=abc&v=2"))).when(F.col("page_id") % 5 == 1, F.lit("unknown")).when(F.col("page_id") % 5 == 2, F.concat(F.lit(" "), "url", F.lit("?x-SIGN=1 "))).otherwise(F.col("url"))
    return p.select("page_id", X.clean_url(url).alias("url"))


def _c13(spark, d):
    p = load(spark, d, "pages")
    line = F.concat(F.lit("see https://me:pw@ab"), "page_id", F.lit("-8000.proxy.pods.example/x and "), "url")
    return p.select("page_id", X.redacted(line, ("proxy.pods.example", "other.example")).alias("line"))


def _c14(spark, d):
    p = load(spark, d, "pages")
    own, k = F.substring(F.md5(F.col("page_id").cast("string")), 1, 12), (F.col("page_id") % 4).cast("int")
    pod = F.concat(F.lit("pod a1"), own, F.lit(" of "), "page_id", F.lit("\n"))
    text = F.concat(F.repeat(pod, k), F.lit("a1"), own, F.lit(" alone\nvolume b2"), F.substring(own, 1, 8), F.lit(" here /home/ann_b/x\n"), F.coalesce("url", F.lit("")))
    return p.select("page_id", X.masked(text).alias("m")).select("page_id", "m.text", F.col("m.n").alias("replacements"))


def _c15(spark, d):
    t = load(spark, d, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I couldn't find this. "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<Think>x</think> It does not state it. "), "text")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", X.is_declined(answer, (F.col("turn") % 2).cast("int")).alias("declined"), X.think_residue(answer).alias("residue"))


_DECLINE_SQL = X.DECLINED.replace("(?i)", "")


def _c16(spark, d):
    e = load(spark, d, "events")
    flag = lambda c: F.concat(F.lit('{"chat_template_kwargs": {"enable_thinking": '), c, F.lit("}}"))
    i = F.col("event_id")
    return e.select("event_id", X.thinking(flag(F.when(i % 2 == 0, "true").otherwise("false")), F.when(i % 3 == 0, flag(F.lit("true"))).when(i % 3 == 1, F.lit("{}")).otherwise(F.lit("not json"))).alias("thinking"))


def _c17(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, F.col("a.vec_id") + 1 == F.col("b.vec_id")).select("a.vec_id", F.round(X.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("cosine"))


def _c18(spark, d):
    e = load(spark, d, "events")
    reply = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    k = F.col("j.k")
    return e.select("event_id", X.parsed(reply, "k long").alias("j")).select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(k / 50, F.lit(0.0)))).alias("confidence"))


def _c20(spark, d):
    r = load(spark, d, "region")
    k = F.col("r_regionkey")
    cell = F.when(k == 0, F.lit("A02–A08")).when(k == 1, F.lit("D11, D12")).when(k == 2, F.lit("B03-B05, C01")).when(k == 3, F.lit("A1")).otherwise(F.lit("A02–B03"))
    grade = F.when(k == 0, F.lit("C ×7")).when(k == 1, F.lit("**C-** x2")).when(k == 2, F.lit("W")).when(k == 3, F.lit("C")).otherwise(F.lit("Z"))
    x = r.select("r_regionkey", X.expanded_ids(cell).alias("ids"), X.parsed_grade(grade).alias("g"))
    good = F.col("ids").isNotNull() & F.col("g.grade").isNotNull() & (F.coalesce("g.count", F.size("ids")) == F.size("ids"))
    return x.withColumn("ok", F.coalesce(good, F.lit(False))).select("r_regionkey", "ok", F.explode_outer(F.when(F.col("ok"), F.col("ids"))).alias("id"), F.when(F.col("ok"), F.col("g.label")).alias("label"))


_C20 = """SELECT * FROM (VALUES (0, true, 'A02', 'correct'), (0, true, 'A03', 'correct'), (0, true, 'A04', 'correct'), (0, true, 'A05', 'correct'), (0, true, 'A06', 'correct'),
 (0, true, 'A07', 'correct'), (0, true, 'A08', 'correct'), (1, true, 'D11', 'partial'), (1, true, 'D12', 'partial'), (2, true, 'B03', 'wrong'), (2, true, 'B04', 'wrong'),
 (2, true, 'B05', 'wrong'), (2, true, 'C01', 'wrong'), (3, false, NULL, NULL), (4, false, NULL, NULL)) t(r_regionkey, ok, id, label)
 WHERE r_regionkey IN (SELECT r_regionkey FROM region)"""


def _c21(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", X.host_of(F.concat(F.lit("http://u:p@"), F.lit("Host"), "page_id", F.lit(":80"), "page_id", F.lit("/a?b@c"))).alias("host"), X.host_of("url").alias("own"))


def _c22(spark, d):
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit("a/../b")).otherwise(F.concat(F.lit("\\ "), "lang", F.lit(" // "), "source", F.lit("/x y/")))
    return load(spark, d, "documents").select("doc_id", X.normalised_folder(raw).alias("folder"))


def _c23(spark, d):
    t = load(spark, d, "conversations").where("role = 'user'")
    words = F.get(F.array(*map(F.lit, ("the library", "tell me", "plain", "Documents please"))), (F.col("conv_id") % 4).cast("int"))
    flags = X.rewrite_flags(F.concat("text", F.lit(" hmis")), F.concat(words, F.lit(" HMIS "), "text"), F.when(F.col("conv_id") % 3 == 0, "library").otherwise("retrieval"))
    return t.select("conv_id", "turn", F.array_join(flags, ",").alias("flags"))


def _b1(spark, d):
    t = F.concat(F.lit("# "), "lang", F.lit("\n"), "text", F.lit("\n### End of "), F.col("doc_id"), F.lit("\n#none"))
    h = X.headings(t)
    return load(spark, d, "documents").select("doc_id", F.size(h).cast("long").alias("n"), F.try_element_at(h, F.lit(1)).alias("label"), F.try_element_at(h, F.lit(-1)).alias("last"))


def _b2(spark, d):
    t = F.concat(F.lit("x\n|a|b|\n|-|-|\n|"), F.col("doc_id"), F.lit("|2|\ntext\n|c|\nend\n"), F.lit("y"))
    return load(spark, d, "documents").select("doc_id", F.array_join(X.tables(t), "#").alias("tables"))


QUERIES = {
    "a2_sanitised_path": (_a2, "SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN lang || '/' || source || '/' || doc_id || '.txt' END AS path FROM documents"),
    "a3_content_digest": (_docs(lambda: [F.sha2("text", 256).alias("digest")]), "SELECT doc_id, sha256(text) AS digest FROM documents"),
    "b1_headings": (_b1, "SELECT doc_id, 2 + len(regexp_extract_all(text, '(?m)^#{1,6}[ \\t]+(.+)$')) AS n, lang AS label, 'End of ' || doc_id AS last FROM documents"),
    "b2_markdown_tables": (_b2, "SELECT doc_id, '|a|b|' || chr(10) || '|-|-|' || chr(10) || '|' || doc_id || '|2|#|c|' AS tables FROM documents"),
    "b3_low_text_pages": (
        lambda s, d: pages(s, d).select("doc_id", "page_number", X.needs_ocr(F.col("text")).alias("needs_ocr")),
        f"SELECT doc_id, page_number, length(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')) < 50 AS needs_ocr FROM {PAGES}",
    ),
    "c1_tokenise": (
        _docs(lambda: [F.size(X.tokenise(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(X.tokenise(F.col("text")), " ")).alias("digest")]),
        r"""SELECT doc_id, cast(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, flatten(list_transform(
          regexp_extract_all(translate(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '*_|', '   '), '[a-z0-9][a-z0-9\-./]*[a-z0-9]|[a-z0-9]'),
          lambda x: CASE WHEN regexp_matches(x, '[-./]') THEN list_concat([x], list_filter(string_split_regex(x, '[-./]'), lambda y: y <> '')) ELSE [x] END)) AS t FROM documents)""",
    ),
    "c2_overlap_tokens": (_docs(lambda: [F.array_join(F.array_sort(X.overlap_tokens(F.col("text"))), " ").alias("tokens")]), f"SELECT doc_id, array_to_string(list_sort({_OVERLAP('text')}), ' ') AS tokens FROM documents"),
    "c3_overlap_score": (
        _c3,
        f"WITH t AS (SELECT doc_id, {_OVERLAP('text')} AS t FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / sqrt(cast(len(a.t) * len(b.t) AS DOUBLE)) ELSE 0 END, 6) AS score FROM t a JOIN t b ON a.doc_id + 1 = b.doc_id",
    ),
    "c4_normalised": (_docs(lambda: [F.md5(X.normalised(F.col("text"))).alias("digest")]), f"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g'))) AS digest FROM documents"),
    "c5_continues": (
        _c5,
        f"WITH c AS (SELECT * FROM {CHUNKS}) SELECT a.chunk_id, {_BAR('a.text')} AS has_row, {_BAR('a.text')} OR {_STEP('a.text')} OR {_BAR('b.text')} OR {_STEP('b.text')} AS continues FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.chunk_index + 1 = b.chunk_index",
    ),
    "c6_basename": (
        lambda s, d: catalogue(s, d).select("id", X.basename(F.col("filename")).alias("base"), F.array_join(X.excluded_keys(F.array("source_path", F.concat(F.lit("A\\B"), "id"))), "|").alias("keys")),
        f"SELECT id, 'doc_' || id || '.txt' AS base, lower(source_path) || '|a\\b' || id || '|doc_' || id || '.txt|b' || id AS keys FROM {CATALOGUE}",
    ),
    "c7_category": (
        _c7,
        f"SELECT id, name, CASE WHEN len(p) > 2 THEN p[2] WHEN len(p) > 1 THEN p[1] ELSE 'uncategorised' END AS category FROM (SELECT id, name, string_split(name, '/') AS p FROM (SELECT id, CASE WHEN n % 7 = 0 THEN 'doc_' || id || '.txt' WHEN n % 7 = 1 THEN 'top' || id ELSE source_path END AS name FROM {CATALOGUE}))",
    ),
    "c8_path_levels": (
        lambda s, d: catalogue(s, d).select("id", *[X.path_level(F.col("filename"), k).alias(x) for k, x in enumerate(("category", "vendor", "family"))]),
        f"SELECT id, batch_id AS category, lang AS vendor, source AS family FROM {CATALOGUE}",
    ),
    "c9_original_path": (
        _c9,
        f"""SELECT id, CASE n % 3 WHEN 0 THEN '\\\\host\\share\\' || replace(source_path, '/', '\\') WHEN 1 THEN '/data/in/' || source_path ELSE source_path END AS original_path,
          CASE n % 3 WHEN 0 THEN '\\\\host\\share' WHEN 1 THEN '/data/in' ELSE '' END AS root, lang || '/' || source AS folder FROM {CATALOGUE}""",
    ),
    "c10_canonical_unc": (_c10, f"""SELECT id, CASE n % 4 WHEN 0 THEN '\\\\fs1\\share\\' || lower(replace(source_path, '/', '\\')) WHEN 1 THEN '\\\\fs2\\docs\\' || lower(replace(source_path, '/', '\\')) END AS unc FROM {CATALOGUE}"""),
    "c11_sid_to_principal": (
        _c11,
        f"SELECT id, CASE n % 10 WHEN 0 THEN '*' WHEN 1 THEN NULL ELSE {_OID} END AS principal, CASE WHEN n % 10 > 1 THEN true END AS inverse_holds FROM {CATALOGUE}",
    ),
    "c12_clean_url": (
        _c12,
        """SELECT page_id, CASE page_id % 5 WHEN 1 THEN '' WHEN 0 THEN CASE WHEN contains(url, '?') AND NOT contains(url, '#') THEN url || '&v=2' ELSE url || '&x-sign=abc&v=2' END
          WHEN 2 THEN CASE WHEN contains(url, '?') OR contains(url, '#') THEN url || '?x-SIGN=1' ELSE url END ELSE url END AS url FROM pages""",
    ),
    "c13_redacted": (_c13, "SELECT page_id, 'see https://<redacted>@<pod-id>-8000.proxy.pods.example/x and ' || url AS line FROM pages"),
    "c14_masked": (_c14, "SELECT page_id, repeat('pod <pod-id> of ' || page_id || chr(10), (page_id % 4)::INT) || 'a1' || substr(md5(page_id::VARCHAR), 1, 12) || ' alone' || chr(10) || 'volume <volume-id> here ~/x' || chr(10) || coalesce(url, '') AS text, (page_id % 4 + 2)::INT AS replacements FROM pages"),
    "c15_declined": (
        _c15,
        f"""SELECT conv_id, turn, turn % 2 = 0 AND (turn % 3 < 2 OR regexp_matches(text, '(?i){_DECLINE_SQL}')) AS declined, turn % 3 = 1 OR regexp_matches(text, '(?i)</?think>') AS residue FROM conversations""",
    ),
    "c16_thinking": (_c16, "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 'on' ELSE 'off' END AS thinking FROM events"),
    "c17_cosine": (_c17, "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id"),
    "c18_parsed_reply": (_c18, "SELECT event_id, k, greatest(0.0, least(1.0, CASE WHEN k < 0 THEN 0 ELSE k / 50 END)) AS confidence FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE cast(json_extract(props, '$.k') AS BIGINT) END AS k FROM events)"),
    "c19_token_count": (_docs(lambda: [X.word_count(F.col("text")).cast("long").alias("tokens")]), r"SELECT doc_id, cast(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS tokens FROM documents"),
    "c20_hand_grades": (_c20, _C20),
    "c21_host": (_c21, "SELECT page_id, 'host' || page_id || ':80' || page_id AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS own FROM pages"),
    "c22_folder": (_c22, "SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN lang || '/' || source || '/x y' END AS folder FROM documents"),
    "c23_rewrite_flags": (
        _c23,
        r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN conv_id % 3 <> 0 AND regexp_matches(r, '(?i)\b(document collection|the collection|the library|in the context of|documents?)\b') THEN 'META' END,
          CASE WHEN regexp_matches(r, '(?i)\b(more information|tell me|can you|please)\b') THEN 'FILLER' END, 'ACRONYM'], lambda x: x IS NOT NULL), ',') AS flags
          FROM (SELECT conv_id, turn, ['the library', 'tell me', 'plain', 'Documents please'][conv_id % 4 + 1] || ' HMIS ' || text AS r FROM conversations WHERE role = 'user')""",
    ),
}
