"""Catalogue of documents: listings, versions, batches, explorer, folders, permissions, corpus manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.edits import above
from folioscope.operators.matching import contained
from folioscope.operators.retrieval import ranked, small
from folioscope.plans.tables import stored

#: Progress of a document by stage (fixed values), and the most that a batch in work shows.
STAGES = {"parsing": 20, "chunking": 50, "embedding": 75}
UNFINISHED = 99
READ_MASK, INHERIT_ONLY = 0x1, 0x8
ORDINALS = ("first", "1st", 1), ("second", "2nd", 2), ("third", "3rd", 3), ("fourth", "4th", 4)


def library_summary(documents: DataFrame) -> DataFrame:
    """Documents, pages and chunks of each category and (category null) in all, of ready documents."""
    ready = documents.where("status = 'ready'").withColumn("category", X.category(F.col("source_path")))
    return ready.rollup("category").agg(F.count(F.lit(1)).alias("documents"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"))


def library_listing(documents: DataFrame) -> DataFrame:
    """(category, listing): a line for each ready document, by path."""
    ready = documents.where("status = 'ready'").withColumn("category", X.category(F.col("source_path")))
    line = F.concat(F.lit("- "), "source_path", F.lit(" ("), "page_count", F.lit(" pages)"))
    rows = F.array_sort(F.collect_list(F.struct("source_path", line.alias("line"))))
    return ready.groupBy("category").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("listing"))


def mark_duplicates(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new (id, file_hash, is_version) with status: skipped_duplicate if a ready document, or an earlier new one, has the hash."""
    known = existing.where("status = 'ready'").select("file_hash").distinct().withColumn("_known", F.lit(True))
    rows = ranked(new.join(known, "file_hash", "left"), ["file_hash"], F.col("id"), name="_n")
    again = (F.coalesce("_known", F.lit(False)) | (F.col("_n") > 0)) & ~F.col("is_version")
    return rows.withColumn("status", F.when(again, "skipped_duplicate").otherwise("pending")).drop("_known", "_n")


def latest_versions(documents: DataFrame, by: str = "source_path") -> DataFrame:
    """The latest ready version of each path."""
    return ranked(documents.where("status = 'ready'"), [by], F.desc("version"), F.desc("id"), name="_n").where("_n = 0").drop("_n")


def version_history(documents: DataFrame, by: str = "source_path") -> DataFrame:
    """documents with place (0: newest) and the number that a new version would get."""
    return ranked(documents, [by], F.desc("version"), F.desc("id"), name="place").withColumn("next_version", F.max("version").over(Window.partitionBy(by)) + 1)


def batch_status(documents: DataFrame) -> DataFrame:
    """Counters, stages in work and weighted progress (under 100 until all are done) of each batch."""
    weight = F.coalesce(*[F.when(F.col("stage") == k, v) for k, v in STAGES.items()], F.lit(0))
    g = documents.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ready").alias("completed"), F.count_if(F.col("status") == "error").alias("failed"),
        *[F.count_if((F.col("status") == "processing") & (F.col("stage") == k)).alias(k) for k in STAGES],
        F.sum(F.when(F.col("status").isin("ready", "error"), 100).when(F.col("status") == "processing", weight).otherwise(0)).alias("_p"),
    )
    over = F.col("completed") + F.col("failed") == F.col("total")
    progress = F.when(over, 100).otherwise(F.least(F.lit(UNFINISHED), F.floor(F.col("_p") / F.col("total"))))
    return g.withColumn("status", F.when(over, F.when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")).otherwise("processing")).withColumn("progress", progress.cast("long")).drop("_p")


def requeue(documents: DataFrame, batches: DataFrame) -> DataFrame:
    """Documents in work of unfinished batches, pending again."""
    open_ = batches.where(F.col("status").isin("pending", "processing")).select("batch_id")
    return documents.where("status = 'processing'").join(open_, "batch_id", "left_semi").withColumn("status", F.lit("pending")).withColumn("stage", F.lit(None).cast("string"))


def enrich_sources(sources: DataFrame, documents: DataFrame, access: DataFrame) -> DataFrame:
    """sources (answer_id, document_id, user_id) with the document's path, empty where the user may not see it."""
    d = documents.select(F.col("id").alias("document_id"), "source_path")
    may = access.select("user_id", "document_id").distinct().withColumn("_may", F.lit(True))
    joined = sources.join(d, "document_id", "left").join(may, ["user_id", "document_id"], "left")
    return joined.withColumn("source_path", F.when(F.coalesce("_may", F.lit(False)), F.coalesce("source_path", F.lit(""))).otherwise("")).drop("_may")


def resolve_documents(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, rule, document_id): what a query's text names: 1 a file name, 2 a quoted part of one, 3 an ordinal, 4 the only document,
    5 most words of names (two at least). The first rule with a match counts."""
    base = X.basename(F.col("filename"))
    d = documents.where("status = 'ready'").select(F.col("id").alias("document_id"), F.lower("filename").alias("_f"), base.alias("_b"), F.array_distinct(F.regexp_extract_all(base, F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("_w"))
    low = F.lower("question")
    quoted = F.transform(F.regexp_extract_all("question", F.lit("""'[^']+'|"[^"]+\""""), F.lit(0)), lambda x: F.lower(X.trimmed(F.substring(x, F.lit(2), F.length(x) - 2))))
    q = stored(queries.select("query_id", low.alias("_q"), F.filter(quoted, lambda x: x != "").alias("_quoted"), F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]{4,}"), F.lit(0))).alias("_t")))
    d = stored(d)
    nth = F.lit(None).cast("int")
    for a, b, n in reversed(ORDINALS):
        nth = F.when(F.contains("_q", F.lit(a)) | F.contains("_q", F.lit(b)), n).otherwise(nth)
    q = q.withColumn("_nth", F.when(F.col("_q").rlike("doc|manual|file"), nth)).withColumn("_the", F.col("_q").rlike("(the|this) doc|(the|this) manual"))
    names = d.select(F.col("document_id").alias("id"), F.explode(F.array_distinct(F.array("_f", "_b"))).alias("pattern"))
    whole = contained(names, q.select(F.col("query_id").alias("key"), F.col("_q").alias("text"))).select(F.col("key").alias("query_id"), F.lit(1).alias("rule"), F.col("id").alias("document_id"))
    parts = q.select(F.col("query_id").alias("id"), F.explode("_quoted").alias("pattern"))
    part = contained(parts, d.select(F.col("document_id").alias("key"), F.col("_f").alias("text"))).select(F.col("id").alias("query_id"), F.lit(2).alias("rule"), F.col("key").alias("document_id"))
    direct = whole.unionByName(part)
    words = d.select("document_id", F.explode("_w").alias("_x")).join(q.select("query_id", F.explode("_t").alias("_x")), "_x").groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("_s"))
    places = ranked(d.withColumn("_one", F.lit(1)), ["_one"], F.col("_b"), F.col("document_id"), name="_i").where(F.col("_i") < len(ORDINALS))  # the first four are looked at
    ordinal = places.join(q, F.col("_i") + 1 == F.col("_nth")).select("query_id", F.lit(3).alias("rule"), "document_id")
    only = d.groupBy().agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").join(q.where("_the")).select("query_id", F.lit(4).alias("rule"), "document_id")
    most = words.where("_s >= 2").withColumn("_m", F.max("_s").over(Window.partitionBy("query_id"))).where("_s = _m").select("query_id", F.lit(5).alias("rule"), "document_id")
    every = direct.unionByName(ordinal).unionByName(only).unionByName(most)
    return every.withColumn("_r", F.min("rule").over(Window.partitionBy("query_id"))).where("rule = _r").drop("_r").distinct()


def explorer(documents: DataFrame) -> DataFrame:
    """documents with root (a label of the batch's first day and id), folder and duplicate_of (the ready document of the same hash)."""
    label = F.concat(F.lit("Upload "), F.date_format(F.min("upload_date").over(Window.partitionBy("batch_id")), "yyyy-MM-dd"), F.lit(" · "), F.substring("batch_id", 1, 8))
    ready = documents.where("status = 'ready'").groupBy("file_hash").agg(F.min(F.struct("upload_date", "id")).alias("_o"))
    rows = documents.withColumn("root", label).withColumn("folder", X.folder_path(F.col("source_path"))).join(ready, "file_hash", "left")
    return rows.withColumn("duplicate_of", F.when(F.col("_o.id") != F.col("id"), F.col("_o.id"))).drop("_o")


def natural_key(c: Column) -> Column:
    """A sort key in which numbers compare by value."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")


def folder_tree(rows: DataFrame, placements: DataFrame) -> DataFrame:
    """(root, path, documents, in_work, sort_key) of every folder and its ancestors; placements (id, root, folder) override."""
    p = placements.select("id", F.col("root").alias("_r"), F.col("folder").alias("_f"))
    placed = rows.join(p, "id", "left").select("id", "status", F.coalesce("_r", "root").alias("root"), F.coalesce("_f", "folder").alias("folder"))
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    paths = F.transform(F.sequence(F.lit(0), F.size("_p")), lambda n: F.array_join(F.slice("_p", F.lit(1), n), "/"))
    each = placed.withColumn("_p", parts).select("id", "status", "root", F.explode(paths).alias("path"))
    g = each.groupBy("root", "path").agg(F.count_distinct("id").alias("documents"), F.count_if(F.col("status") == "processing").alias("in_work"))
    return g.withColumn("sort_key", natural_key(F.col("path")))


def deletable(folders: DataFrame, placements: DataFrame) -> DataFrame:
    """folders (root, path) with blocked: whether a placement (root, folder) lies at or under it, or another folder under it."""
    over = F.filter(above(F.col("path")), lambda x: x != F.col("path"))
    inner = folders.select("root", F.explode(over).alias("path")).unionByName(placements.select("root", F.explode(above(F.col("folder"))).alias("path"))).distinct()
    return folders.join(inner.withColumn("blocked", F.lit(True)), ["root", "path"], "left").na.fill(False, ["blocked"])


def selection_state(nodes: DataFrame, scope: DataFrame) -> DataFrame:
    """(root, path, state): none, some or all of a node's documents (root, path, id) are in scope (id)."""
    rows = nodes.join(scope.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    g = rows.groupBy("root", "path").agg(F.count("_in").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return g.select("root", "path", F.when(F.col("_k") == 0, "none").when(F.col("_k") == F.col("_n"), "all").otherwise("some").alias("state"))


def scope_of(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """(id) of the documents of selected folders (root, path): all that nodes (root, path, id) list under them, once each."""
    return nodes.join(selected.select("root", "path").distinct(), ["root", "path"], "left_semi").select("id").distinct()


#: What becomes of a document in a crawl, besides ok and blank_path.
DENIED, UNREACHABLE, UNPARSED = "access_denied", "unreachable", "parse_error"


def crawl_status(path: Column, error: Column, stage: Column) -> Column:
    """The status of a crawled document: no path, no error, an error while its entries were parsed, a denied access, or any other error."""
    low = F.lower(error)
    denied = F.contains(low, F.lit("access")) & F.contains(low, F.lit("denied"))
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "blank_path").when(error.isNull(), "ok").when(stage == "parse", UNPARSED).when(denied, DENIED).otherwise(UNREACHABLE)


def crawl_summary(acl: DataFrame) -> DataFrame:
    """(status, documents, unresolved, last_crawl) of acl (document_id, status, unresolved: array, crawled_at): counts by status, and in all (status null) with the
    number of distinct identifiers that no principal was found for and the time of the last crawl."""
    names = acl.select(F.explode("unresolved").alias("sid")).agg(F.count_distinct("sid").alias("unresolved"))  # one row
    whole = acl.agg(F.count(F.lit(1)).alias("documents"), F.max("crawled_at").alias("last_crawl")).crossJoin(names).withColumn("status", F.lit(None).cast("string"))
    by = acl.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.max("crawled_at").alias("last_crawl")).withColumn("unresolved", F.lit(None).cast("long"))
    return by.unionByName(whole)


def failing(acl: DataFrame, most: int = 200) -> DataFrame:
    """The first documents, by id, whose crawl failed, with their error: a list for an administrator, of most rows."""
    return acl.where("status <> 'ok'").orderBy("document_id").limit(most).select("document_id", "path", "status", "error")


def evaluate_aces(aces: DataFrame) -> DataFrame:
    """(document_id, allow_all, principals, denied, unresolved) of entries (document_id, ace_type, flags, mask, sid): those that
    are inherited only or don't read are left out; a denied everyone clears what is allowed."""
    rows = aces.where((F.col("flags").bitwiseAND(INHERIT_ONLY) == 0) & (F.col("mask").bitwiseAND(READ_MASK) != 0)).withColumn("who", X.sid_to_principal(F.col("sid")))
    allow, deny = F.col("ace_type") == "allow", F.col("ace_type") == "deny"
    g = rows.groupBy("document_id").agg(F.array_sort(F.collect_set(F.when(allow, F.col("who")))).alias("_a"), F.array_sort(F.collect_set(F.when(deny, F.col("who")))).alias("_d"), F.count_if(F.col("who").isNull()).alias("unresolved"))
    shut = F.array_contains("_d", "*")
    every = aces.select("document_id").distinct()
    empty = F.array().cast("array<string>")
    made = g.select("document_id", (F.array_contains("_a", "*") & ~shut).alias("allow_all"), F.when(shut, empty).otherwise(F.array_except(F.array_except("_a", "_d"), F.array(F.lit("*")))).alias("principals"), F.col("_d").alias("denied"), "unresolved")
    return every.join(made, "document_id", "left").select("document_id", F.coalesce("allow_all", F.lit(False)).alias("allow_all"), F.coalesce("principals", empty).alias("principals"), F.coalesce("denied", empty).alias("denied"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def access(users: DataFrame, acl: DataFrame, now: Column, stale_days: int = 7) -> DataFrame:
    """(user_id, document_id) of what users may see: nothing of stale or failed crawls; deny of the user or a group goes before allow.

    users: user_id, groups; acl: document_id, allow_all, principals, denied, status, last_ok_at. Users and documents meet by principal:
    the user, the groups, and everyone."""
    none = F.array().cast("array<string>")
    me = F.array_distinct(F.concat(F.array("user_id", F.lit("*")), F.coalesce("groups", none)))
    mine = small(users.select("user_id", F.explode(me).alias("_p")))
    fresh = F.coalesce((F.col("status") == "ok") & (F.col("last_ok_at") >= now - F.make_dt_interval(F.lit(stale_days))), F.lit(False))
    open_ = acl.where(fresh & ~F.array_contains("denied", "*"))
    granted = F.array_distinct(F.concat("principals", F.when(F.col("allow_all"), F.array(F.lit("*"))).otherwise(none)))
    allowed = open_.select("document_id", F.explode(granted).alias("_p")).join(mine, "_p").select("user_id", "document_id").distinct()
    denied = open_.select("document_id", F.explode("denied").alias("_p")).join(mine, "_p").select("user_id", "document_id").distinct()
    return allowed.join(denied, ["user_id", "document_id"], "left_anti")


def visible_roots(documents: DataFrame, access: DataFrame) -> DataFrame:
    """(user_id, root, documents): the roots of documents (id, root) in which a user may see any (access: user_id, id), and how many there."""
    return access.join(documents, "id").groupBy("user_id", "root").agg(F.count(F.lit(1)).alias("documents"))


def corpus_index(manifest: DataFrame) -> DataFrame:
    """Per category and (null) in all: documents, pages, size, vendors, with an address, cited."""
    m = manifest.withColumn("category", X.path_level(F.col("path"), 0)).withColumn("vendor", X.path_level(F.col("path"), 1))
    return m.rollup("category").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("size_bytes").alias("size_bytes"), F.count_distinct("vendor").alias("vendors"), F.count_if(F.col("source_url") != "").alias("with_url"), F.count_if(F.col("golden_questions") != "").alias("cited")
    )


def vendor_listing(manifest: DataFrame) -> DataFrame:
    """Per category, vendor and product family (null where a path has no such folder): documents and pages, and for each vendor (family null, whole true) and
    category (vendor null too) the same in all, with how many families there are."""
    m = manifest.select("pages", *[F.nullif(X.path_level(F.col("path"), k), F.lit("")).alias(n) for k, n in enumerate(("category", "vendor", "family"))])
    sums = [F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.count_distinct("family").alias("families")]
    none = F.lit(None).cast("string")
    each = m.groupBy("category", "vendor", "family").agg(*sums).withColumn("whole", F.lit(False))
    vendors = m.groupBy("category", "vendor").agg(*sums).withColumns({"family": none, "whole": F.lit(True)})
    whole = m.groupBy("category").agg(*sums).withColumns({"vendor": none, "family": none, "whole": F.lit(True)})
    return each.unionByName(vendors).unionByName(whole)


def build_manifest(files: DataFrame, log: DataFrame, golden: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files (path, pages, size_bytes, sha256) with source_url of log (path, url), or of known (path, source_url: an earlier manifest) where the log has none, and
    the ids of golden (id, sources) that cite them."""
    urls = log.groupBy("path").agg(F.max(X.clean_url(F.col("url"))).alias("source_url"))
    ids = golden.select("id", F.explode("sources").alias("_b")).groupBy("_b").agg(F.array_join(F.array_sort(F.collect_set("id")), " ").alias("golden_questions"))
    rows = files.withColumn("_b", X.basename(F.col("path"))).join(urls, "path", "left").join(ids, "_b", "left").drop("_b")
    if known is not None:
        older = known.groupBy("path").agg(F.max("source_url").alias("_known"))
        rows = rows.join(older, "path", "left").withColumn("source_url", F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")).otherwise(F.col("_known"))).drop("_known")
    return rows.na.fill("", ["source_url", "golden_questions"])


def fetch_status(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """manifest (path, sha256, source_url) with status by inventory (path, have)."""
    rows = manifest.join(inventory.select("path", "have"), "path", "left")
    return rows.withColumn("status", F.when(F.col("have") == F.col("sha256"), "present").when(F.col("have").isNotNull(), "differs").when(F.coalesce("source_url", F.lit("")) == "", "no-url").otherwise("would-fetch")).drop("have")


def acl_upsert(acl: DataFrame, crawl: DataFrame) -> DataFrame:
    """acl with crawl's (document_id, status, principals, crawled_at) results: a failure moves status and time, not principals."""
    c = crawl.select("document_id", F.col("status").alias("_s"), F.col("principals").alias("_p"), F.col("crawled_at").alias("_t"))
    rows = acl.join(c, "document_id", "full_outer")
    ok = F.col("_s") == "ok"
    return rows.select("document_id", F.coalesce("_s", "status").alias("status"), F.when(ok, F.col("_p")).otherwise(F.col("principals")).alias("principals"), F.coalesce("_t", "crawled_at").alias("crawled_at"), F.when(ok, F.col("_t")).otherwise(F.col("last_ok_at")).alias("last_ok_at"))
