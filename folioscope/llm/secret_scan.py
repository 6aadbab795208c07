"""Secret scans through an incremental blob ledger (DataFrame functions only).

Every version of every document is content-addressed by the SHA-256 of its whole text (its blob). A ledger lists the
(blob, rule, rule version) triples that earlier runs have scanned; only unseen pairs are scanned, each blob once however many
paths carry it, and findings are joined back to all paths. Spans are code points, end exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import own_columns, saved, shared_folder, table


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts (0: the whole match); version changes whenever the rule does."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed, then further ones that only add spans.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # maximal runs: those of 24 and more are the matches of [0-9a-f]+ that stay
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
RULES = BASE + MORE


#: Blobs of 64 characters that are broadcast at most.
FEW_BLOBS = 200_000

_SPANS = "array<struct<start:int,kind_order:int,end:int>>"


def _lengths(text: Column, rule: Rule) -> Column:
    """Of a rule's leftmost matches the lengths of the gap before, of the match, and of what counts of it."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = hits if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))
    return F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), judged.alias("judged")),
        lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("length"), (F.char_length(x["judged"]) >= rule.least).alias("counts")),
    )


def _spans(fresh: DataFrame, rules: tuple[Rule, ...], tried: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of fresh (blob, text, todo), blobs with findings only, by those of rules that are tried: the sums of lengths are positions."""
    none = F.array().cast("array<struct<gap:int,length:int,counts:boolean>>")
    per_rule = [F.when(F.array_contains("todo", _name(r)) & F.col("text").rlike(r.pattern), _lengths(F.col("text"), r)).otherwise(none) if r in tried else none for r in rules]
    by_rule = fresh.select("blob", F.posexplode(F.array(*per_rule)).alias("kind_order", "hits")).where(F.size("hits") > 0)
    hits = by_rule.select("blob", "kind_order", F.posexplode("hits").alias("nth", "hit")).select("blob", "kind_order", "nth", "hit.*")
    upto = Window.partitionBy("blob", "kind_order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("int")).where("counts")
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "kind_order", "end")
    return placed.groupBy("blob").agg(F.collect_list(span).cast(_SPANS).alias("spans"))


def _name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def ledger_rows(todo: DataFrame) -> DataFrame:
    """(blob, rule, version) of the pairs that a run scans: what it adds to the ledger."""
    pair = F.split("pair", ":")
    return todo.select("blob", F.explode("todo").alias("pair")).select("blob", pair[0].alias("rule"), pair[1].cast("int").alias("version"))


def _matching(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows whose text has a match of any of the rules; each blob once."""
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col("text").rlike(r.pattern)
    return rows.where(any_rule).dropDuplicates(["blob"])


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan docs (doc_id, text); returns (per row of docs: doc_id, blob, spans), (new findings: blob, spans), (new ledger rows).

    ledger and findings are those of earlier runs, whose rules begin these. A rule version that the ledger doesn't know is tried on every text; one that it
    knows on texts of blobs alone that it lacks for it, which are found before any text is looked at. A null text is empty; a repeated row gives the row
    again; an empty table gives no rows; a null doc_id is a path like any other; other columns are ignored. spans are sorted by start, then by the rules' order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = own_columns(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.sha2(text, 256).alias("blob"))
    versions = saved(source.select("doc_id", "blob"), "versions")
    blobs = versions.select("blob").distinct()
    every = F.array(*[F.lit(_name(r)) for r in rules])
    if ledger is None:
        fresh, todo = rules, blobs.withColumn("todo", every)
    else:
        known = {f"{r[0]}:{r[1]}" for r in ledger.select("rule", "version").distinct().collect()}  # rule versions, not blobs
        fresh = tuple(r for r in rules if _name(r) not in known)
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")
        todo = saved(todo, "todo")
    found = []
    if fresh:
        found.append(_spans(_matching(source, fresh).withColumn("todo", every), rules, fresh))
    old = tuple(r for r in rules if r not in fresh)
    if old:
        lacking = todo.where(F.arrays_overlap("todo", F.array(*[F.lit(_name(r)) for r in old])))
        n = lacking.count()
        if n:
            lacking = F.broadcast(lacking) if n <= FEW_BLOBS else lacking
            found.append(_spans(_matching(source.join(lacking, "blob"), old), rules, old))
    new = saved(_sorted(found), "findings") if found else docs.sparkSession.createDataFrame([], f"blob string, spans {_SPANS}")
    whole = new if findings is None else _sorted([new, findings])
    out = versions.join(whole, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return out, new, ledger_rows(todo)


def _sorted(found: list[DataFrame]) -> DataFrame:
    """One row for each blob of some findings, its spans in order and once each."""
    return reduce(DataFrame.unionByName, found).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scan_with_ledger(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """scan() of what the ledger in a folder of the shared store doesn't list yet; returns doc_id, blob and spans per row of docs.

    A run adds its own findings and ledger rows alone, findings first, so that one that fails between them is only repeated (a span that was written
    twice counts once). The first run makes the folder; an empty table adds nothing; nulls and repeated rows as in scan().
    """
    spark, parts = docs.sparkSession, ("ledger", "findings")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger/_SUCCESS")
    begun = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    ledger, findings = (spark.read.parquet(f"{folder}/{x}") for x in parts) if begun else (None, None)
    rows, new, pairs = scan(docs, ledger, findings, rules)
    new.write.mode("append").parquet(f"{folder}/findings")
    pairs.write.mode("append").parquet(f"{folder}/ledger")
    return rows


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind_order"]), x["start"], x["end"])), ",")


#: Code points in the pieces that a text is cut into when parts of it are taken out.
_PIECE = 256


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping spans replaced by the mask and n_chars, if any, counted again; texts without findings are untouched.

    A null text stays null; repeated rows and rows with a null doc_id are masked alike; columns may have any names; an empty table stays empty.
    """
    matches = F.lit(False)
    for r in RULES:
        matches = matches | F.col("text").rlike(r.pattern)
    matches = F.coalesce(matches, F.lit(False))
    _, found, _ = scan(docs.where(matches))
    each = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    before = Window.partitionBy("blob").orderBy("start", "kind_order").rowsBetween(Window.unboundedPreceding, -1)
    cuts = each.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    gap = F.when(F.col("start") >= F.col("at"), F.struct("at", "start"))
    gaps = cuts.groupBy("blob").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("end").alias("last"))  # collect_list leaves nulls out

    tagged = docs.where(matches).select(F.struct("*").alias("doc"), F.sha2("text", 256).alias("blob")).join(gaps, "blob", "left")
    tagged = tagged.withColumn("pieces", F.when(F.col("gaps").isNotNull(), F.regexp_extract_all("doc.text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def part(a: Column, b: Column) -> Column:
        """Code points a to b, from the pieces that hold them."""
        first = F.floor(a / _PIECE).cast("int")
        own = F.array_join(F.slice("pieces", first + 1, F.floor((b - 1) / _PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(own, a % _PIECE + 1, b - a)).otherwise("")

    head = F.array_join(F.transform("gaps", lambda x: F.concat(part(x["at"], x["start"]), F.lit(mask))), "")
    text = F.when(F.col("gaps").isNotNull(), F.concat(head, part(F.col("last"), F.char_length("doc.text")))).otherwise(F.col("doc.text"))
    doc = F.col("doc").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(F.col("gaps").isNotNull(), F.char_length("clean").cast("long")).otherwise(F.col("doc.n_chars")))
    clean = tagged.withColumn("clean", text).select(doc.alias("doc")).select("doc.*")
    return docs.where(~matches).unionByName(clean)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one ledger: the base rules, then all rules, of which only the further ones are left to scan."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    scan_with_ledger(docs, folder, BASE)
    rows = scan_with_ledger(docs, folder, RULES)
    base = F.filter("spans", lambda x: x["kind_order"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind_order"] == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(described(base), 256).alias("base_sha256"), described(F.col("spans")).alias("spans")
    )


def _oracle() -> str:
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = {
        "assign": (f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": ("AKIA[A-Z0-9]+", 0, 20),
        "hex": ("[0-9a-f]+", 0, 24),
        "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
        "forge": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    }
    parts = []
    for k, (kind, (p, group, least)) in enumerate(patterns.items()):
        gaps = f"string_split_regex(t, '{p}')"
        hits, judged = f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {group})"
        parts.append(
            f"SELECT doc_id, t, {k} AS k, '{kind}' AS kind, i, length(hits[i]) AS n, length(judged[i]) AS j, "
            f"list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s, {least} AS least "
            f"FROM (SELECT doc_id, t, gaps, hits, judged, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, t, {gaps} AS gaps, {hits} AS hits, {judged} AS judged FROM d))"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT doc_id, k, kind, cast(s AS BIGINT) AS s, cast(s + n AS BIGINT) AS e FROM m WHERE j >= least),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS a
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op7_secret_scan": (op7_secret_scan, _oracle())}
