"""Evaluation queries over labelled documents as questions, three repeats and two conditions, and over events as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import campaign as C
from folioscope.operators import evaluation as V
from folioscope.operators.retrieval import containing, ranked
from folioscope.plans.retrieval_queries import _BM25, _chunks, _d3
from folioscope.plans.tables import CHUNKS, chunks, load


def _records(spark, d):
    """An answer for each labelled document, repeat and condition."""
    x = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    x = x.withColumn("repeat", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("condition", F.explode(F.array(F.lit("off"), F.lit("on"))))
    flip = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "repeat", "doc_id")), 1, 8), 16, 10).cast("long"), F.lit(10)) == 0
    base = F.when(F.col("condition") == "off", F.col("quality")).otherwise(1 - F.col("toxic"))
    i = F.col("doc_id")
    return x.select(
        F.concat(F.lit("q"), i).alias("id"), i.alias("number"), F.col("lang").alias("category"), "repeat", "condition", F.concat(F.lit("r"), i % 2).alias("rung"),
        F.when((i % 2 == 1) & (F.col("repeat") == 3), "b").otherwise("a").alias("gpu"), (i % 8 != 0).alias("answerable"),
        F.when(i % 13 == 0, None).otherwise(F.when(flip, 1 - base).otherwise(base)).alias("score"), "quality", (1 - F.col("toxic")).alias("other"),
        F.when(i % 6 != 0, i % 4 != 0).alias("source_hit"), (i % 5 != 0).alias("cited"), (i % 97 != 0).alias("pages_ok"), (i % 8 == 0).alias("declined"),
        (5 + F.col("n_chars") % 700 / 100.0 + F.col("repeat")).alias("latency_s"), (F.col("n_chars") % 900 + 100).alias("tokens"), (F.col("n_chars") % 50 * (i % 3)).alias("reasoning"),
    )


_R = """rec AS (SELECT 'q' || doc_id AS id, doc_id AS number, lang AS category, repeat, condition, 'r' || doc_id % 2 AS rung, CASE WHEN doc_id % 2 = 1 AND repeat = 3 THEN 'b' ELSE 'a' END AS gpu,
  doc_id % 8 <> 0 AS answerable, CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN cast('0x' || substr(md5(repeat || ':' || doc_id), 1, 8) AS BIGINT) % 10 = 0 THEN 1 - base ELSE base END END AS score,
  quality, 1 - toxic AS other, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 4 <> 0 END AS source_hit, doc_id % 5 <> 0 AS cited, doc_id % 97 <> 0 AS pages_ok, doc_id % 8 = 0 AS declined,
  5 + n_chars % 700 / 100.0::DOUBLE + repeat AS latency_s, n_chars % 900 + 100 AS tokens, n_chars % 50 * (doc_id % 3) AS reasoning
  FROM (SELECT *, CASE WHEN condition = 'off' THEN quality ELSE 1 - toxic END AS base FROM labels JOIN documents USING (doc_id), (VALUES (1), (2), (3)) a(repeat), (VALUES ('off'), ('on')) b(condition)))"""


def _entries(spark, d):
    """What judges said of the answers: verdict, reason, claims and citations."""
    i, r = F.col("number"), F.col("repeat")
    label = F.when(F.col("score").isNull(), None).when(~F.col("answerable"), F.when((i + r) % 3 > 0, "declined").otherwise("answered_wrong")).when(F.col("score") == 1, "correct").otherwise(F.get(F.array(*map(F.lit, ("partial", "abstained", "wrong"))), ((i + r) % 3).cast("int")))
    flags = lambda n, m: F.transform(F.slice(F.array(*map(F.lit, (0, 1, 2))), F.lit(1), (i % n).cast("int")), lambda k: (i + k + r) % m > 0)
    rows = _records(spark, d).withColumns({"label": label, "claims": flags(4, 3), "citations": flags(3, 2)})
    return rows.withColumn("reason", F.concat_ws(" ", F.lit("Judged"), "label", F.repeat(F.lit("because "), (i % 70).cast("int"))))


_E = """ent AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN NOT answerable THEN CASE WHEN (number + repeat) % 3 > 0 THEN 'declined' ELSE 'answered_wrong' END WHEN score = 1 THEN 'correct' ELSE ['partial', 'abstained', 'wrong'][(number + repeat) % 3 + 1] END AS label,
  list_transform(([0, 1, 2])[:number % 4], lambda k: (number + k + repeat) % 3 > 0) AS claims, list_transform(([0, 1, 2])[:number % 3], lambda k: (number + k + repeat) % 2 > 0) AS citations FROM rec)"""
_JUDGED = ", ".join(
    [f"count(*) FILTER (answerable AND label = '{v}') AS {v}" for v in ("correct", "partial", "wrong", "abstained")] + [f"count(*) FILTER (NOT answerable AND label = '{v}') AS {v}" for v in ("declined", "answered_wrong")]
    + ["count(*) FILTER (NOT answerable AND label IS NOT NULL) AS unanswerable", "count(*) FILTER (label IS NULL) AS ungraded", "round(count(*) FILTER (NOT answerable AND label = 'declined') / nullif(count(*) FILTER (NOT answerable AND label IS NOT NULL), 0), 6) AS declined_rate"]
    + [f"cast(sum(len({c})) AS BIGINT) AS {c}, round(sum(len(list_filter({c}, lambda x: x))) / nullif(sum(len({c})), 0), 6) AS {n}" for c, n in (("claims", "supported_rate"), ("citations", "used_rate"))]
)


def _pq(spark, d):
    return V.per_question(_records(spark, d), ["condition"])


_PQ = f"{_R}, pq AS (SELECT condition, id, avg(score) AS score FROM rec WHERE answerable AND score IS NOT NULL GROUP BY ALL)"


def _boot(rows, name, keys=("id",)):
    """SQL of the bootstrap of rows (condition, id, v)."""
    return f"""num AS (SELECT condition, v, row_number() OVER (PARTITION BY condition ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM ({rows})),
    drw AS (SELECT condition, s, cast('0x' || substr(md5('7:' || s || ':' || i), 1, 8) AS BIGINT) % n AS i FROM num, range(10000) r(s)),
    mns AS (SELECT drw.condition, s, avg(v) AS m FROM drw JOIN num ON num.condition = drw.condition AND num.i = drw.i GROUP BY ALL),
    {name} AS (SELECT condition, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
      FROM mns JOIN (SELECT condition, avg(v) AS mean, count(*) AS n FROM num GROUP BY 1) USING (condition) GROUP BY condition)"""


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _j1(spark, d):
    return _rounded(V.bootstrap(_pq(spark, d), ["condition"], "score"), "mean", "low", "high")


def _j3(spark, d):
    x = _pq(spark, d)
    a, b = (x.where(F.col("condition") == c).select("id", F.col("score").alias(c)) for c in ("off", "on"))
    diff = a.join(b, "id").select(F.lit("delta").alias("condition"), "id", (F.col("on") - F.col("off")).alias("v"))
    return _rounded(V.bootstrap(diff, ["condition"], "v"), "mean", "low", "high")


def _j4(spark, d):
    o = load(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("b"), (F.col("s_suppkey") * 7 % 30).alias("c")).distinct()
    return o.select("b", "c", F.round(V.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def _j5(spark, d):
    x = _records(spark, d).where("answerable AND score IS NOT NULL").groupBy("condition", "id").agg(F.avg("score").alias("score"), F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"))
    return _rounded(V.compare(x.where("condition = 'off'"), x.where("condition = 'on'")), "delta", "p")


_MC = "CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, cast(least(b, c) AS BIGINT) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


def _hits(spark, d):
    h = _d3(spark, d).join(_chunks(spark, d).select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    return h.select("query_id", F.col("doc_id").alias("source"), F.col("chunk_index").alias("page_start"), (F.col("chunk_index") + 1).alias("page_end"), "chunk_id", "rank", "score")


def _expected(spark, d):
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("body"))
    return containing(b, docs).select("query_id", "source", F.when(F.col("source") % 2 == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array().cast("array<int>")).alias("pages"))


_H = f"""{_BM25}, hit AS (SELECT query_id, doc_id AS source, chunk_index AS page_start, chunk_index + 1 AS page_end, s.chunk_id, rank, score FROM sparse s JOIN c ON c.chunk_id = s.chunk_id),
exp AS (SELECT item_id AS query_id, doc_id AS source, CASE WHEN doc_id % 2 = 0 THEN [0, 3] ELSE [] END AS pages FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
grd AS (SELECT h.*, CASE WHEN pages IS NULL THEN 0 WHEN len(list_filter(pages, lambda p: p BETWEEN page_start AND page_end)) > 0 THEN 2 ELSE 1 END AS relevance FROM hit h LEFT JOIN exp USING (query_id, source))"""


def _i2(spark, d):
    return V.graded(_hits(spark, d), _expected(spark, d)).select("query_id", "chunk_id", "rank", "relevance")


def _i6(spark, d):
    e = _expected(spark, d).select("query_id", "source", F.when(F.size("pages") > 0, 2).otherwise(1).alias("best"))
    return _rounded(V.retrieval_metrics(V.graded(_poor(spark, d), _expected(spark, d)), e), "recall", "mrr", "ndcg")


def _i9(spark, d):
    listed = F.when(F.col("query_id") % 3 != 0, (F.col("source") % 11 == 0).cast("int"))  # every third query lists no distractor
    return C.page_hits(V.graded(_hits(spark, d), _expected(spark, d)), listed)


def _poor(spark, d, which="true"):
    """Hits in an order that has nothing to do with their score, so that metrics differ from query to query."""
    return ranked(_hits(spark, d).where(which).drop("rank"), ["query_id"], F.md5("chunk_id"), F.col("chunk_id"))


def _i3(spark, d):
    e = _expected(spark, d).select("query_id", "source", F.lit(1).alias("best"))
    g = V.graded(_poor(spark, d, "rank % 3 > 0"), _expected(spark, d))  # a third of the hits is lost
    fused, kept = (V.retrieval_metrics(g, e, k).select("query_id", F.round("recall", 6).alias(f"recall_at_{k}")) for k in (20, 8))
    return fused.join(kept, "query_id")


def _i5(spark, d):
    h = _hits(spark, d)
    lists = h.select("query_id", F.lit(1).alias("call"), "rank", "source").unionByName(h.select("query_id", F.lit(2).alias("call"), (20 - F.col("rank")).alias("rank"), "source"))
    return V.best_ranks(lists, ["source"])


def _i7(spark, d):
    x = _records(spark, d).select("id", "number").distinct()
    n = F.col("number")
    name = lambda k: F.concat(F.lit("s"), (n % k).cast("string"))
    cited, expected = F.array(name(3), name(4)), F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(name(4), name(5)))
    return x.select("id", V.source_hit(cited, expected, F.when(n % 2 == 0, "all").otherwise("any")).alias("hit"))


def _i4(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.ceil(F.char_length("text") / 2000).alias("page_count"))
    return C.pages_ok(docs.select(F.col("doc_id").alias("id"), "doc_id", (F.col("doc_id") % 5 + 1).alias("page")), docs)


def _i8(spark, d):
    x = _records(spark, d).select("id", "number", "category").distinct()
    wanted = load(spark, d, "documents").where("doc_id % 3 = 0").select(F.concat(F.lit("q"), "doc_id").alias("id"))
    return V.subset(x, wanted)


def _i10(spark, d):
    return _rounded(V.scorecard(_records(spark, d), ["condition", "repeat"]), "hit_rate", "cited_rate", "latency_median", "latency_p90", "latency_max")


def _calls(spark, d):
    e = load(spark, d, "events")
    return e.select("user_id", F.col("event_type").alias("purpose"), F.col("value").alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_id") % 17 == 0, "length").otherwise("stop").alias("finish"), "ts")


_CALLS = "cal AS (SELECT user_id, event_type AS purpose, value AS ms, cast(json_extract(props, '$.k') AS BIGINT) AS tokens, CASE WHEN event_id % 17 = 0 THEN 'length' ELSE 'stop' END AS finish, ts FROM events)"


def _i12(spark, d):
    s = V.scorecard(_records(spark, d), ["condition", "category", "rung"])
    return _rounded(V.gate(s.select("condition", "category", "rung", "hit_rate"), "hit_rate", 0.8), "hit_rate")


def _i14(spark, d):
    c = _calls(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    return C.trace_rollup(c, ["user_id", "day"]).withColumn("ms", F.round("ms", 4))


def _i15(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("lang").alias("folder"))
    cited = docs.select((F.col("doc_id") * 7 % 200).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("folder"))
    return C.outside_scope(cited, docs, "folder")


def _i16(spark, d):
    c = chunks(spark, d)
    broken = C.index_gate(c.where("chunk_index % 50 <> 7"), c.where("chunk_index % 50 <> 9"), load(spark, d, "documents"), c.count())
    whole = C.index_gate(c, c, load(spark, d, "documents").join(c, "doc_id", "left_semi"), c.count())
    return broken.unionByName(whole).unionByName(C.index_gate(c, c, load(spark, d, "documents").join(c, "doc_id", "left_semi"), c.count() + 1))


def _i17(spark, d):
    r = _records(spark, d)
    golden = r.select("id", "number", "category", "answerable").distinct()
    return C.with_manifest(r, ["rung", "condition"], golden, index_chunks=chunks(spark, d).count(), settings="k=20;keep=12")


def _j2(spark, d):
    return _rounded(_pq(spark, d).groupBy("condition").agg(F.count(F.lit(1)).alias("questions"), F.avg("score").alias("rate")), "rate")


def _with_metrics(spark, d):
    return _records(spark, d).withColumns({"recall": F.when(F.col("number") % 6 > 0, F.col("number") % 5 / 4), "mrr": 1 / (F.col("number") % 7 + F.col("repeat"))})


_WM = "wm AS (SELECT *, CASE WHEN number % 6 > 0 THEN number % 5 / 4 END AS recall, 1 / (number % 7 + repeat) AS mrr FROM rec)"


def _j6(spark, d):
    return _rounded(C.config_summary(_with_metrics(spark, d), _entries(spark, d), ["condition"]), "declined_rate", "supported_rate", "used_rate", "source_hit_rate", "recall", "mrr", "tokens", "correct_rate")


def _j6_categories(spark, d):
    return _rounded(C.category_rates(_with_metrics(spark, d), _entries(spark, d), ["condition"]), "recall", "correct_rate")


def _j7(spark, d):
    return _rounded(C.latencies(_records(spark, d), ["condition"]), "median", "tokens", "reasoning", "p90")


def _j8(spark, d):
    return _rounded(C.costs(_records(spark, d), F.when(F.col("condition") == "on", 2.0)), "sequential", "concurrent")


def _j9(spark, d):
    x = _calls(spark, d).withColumn("concurrency", F.col("user_id") % 3).withColumn("error", F.col("purpose") == "error")
    x = x.withColumns({"started": F.col("ts").cast("timestamp"), "first_ms": F.col("ms") * (F.col("user_id") % 5 + 1) / 8})
    found = C.load_levels(x)
    return _rounded(found, *[c for c in found.columns if c not in ("concurrency", "ok", "errors")])


def _j10(spark, d):
    x = load(spark, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("r"), F.col("user_id") % 6).alias("rung"), F.col("value").alias("cost"))
    return C.spend(x, 1000).withColumn("cost", F.round("cost", 4))


def _j10_running(spark, d):
    x = load(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("number"), F.col("ts").alias("at"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return C.spent_so_far(x, 1_000_000).select("number", "spent", "within")


def _j11(spark, d):
    found = C.call_metrics(_calls(spark, d).withColumn("id", F.col("user_id")), ["view", "click"])
    return _rounded(found, "rate_median", "ms_median", "tokens_per_question")


def _j11_approximate(spark, d):
    r = _records(spark, d).withColumn("answer_ms", F.when(F.col("number") % 9 > 0, F.col("latency_s") * 700))
    return _rounded(C.approximate_call_metrics(r, ["condition", "rung"]), "rate_median", "ms_median", "reasoning_per_question")


def _j12(spark, d):
    x = _pq(spark, d).join(_records(spark, d).select("id", "rung").distinct(), "id")
    return _rounded(C.paired_conditions(x, "off", "on", ["r1", "r0"]), "off", "on", "delta")


def _j13(spark, d):
    return _rounded(C.stability(_records(spark, d)), "share")


def _j13_mix(spark, d):
    return _rounded(C.verdict_mix(_entries(spark, d), ["condition"]), *[f"{v}_share" for v in C.VERDICTS], "mean", "low", "high")


def _j14(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("number"), F.col("text").alias("answer"))
    r = _records(spark, d).join(texts, "number").withColumn("cited", F.array(F.concat(F.lit("d"), F.col("number") % 5), F.col("category")))
    cell = lambda x: F.concat_ws("|", x["repeat"].cast("string"), F.coalesce(x["label"], F.lit("-")), x["reason"], F.md5(x["answer"]), F.array_join(x["cited"], "+"), F.round(x["latency_s"], 2).cast("string"))
    return C.question_matrix(r, _entries(spark, d), "condition").select("id", *[F.md5(F.array_join(F.transform(F.col("cells")[c], cell), "#")).alias(c) for c in ("off", "on")])


def _j15(spark, d):
    x = load(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("cause"), F.col("event_id").alias("number"), (F.col("event_id") % 4).alias("rung"))
    return C.diagnosis(x)


def _j16(spark, d):
    return _rounded(C.reasoning_lengths(_records(spark, d)), "median")


def _j17(spark, d):
    return V.balanced_subset(_records(spark, d).select("id", "number", "category").distinct(), 24, ("fr",)).select("id", "category")


def _j18(spark, d):
    return _rounded(C.rung_summary(_records(spark, d)), "latency", "tokens")


def _j19(spark, d):
    return V.config_key(_records(spark, d)).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


def _j20(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return C.boot_timeline(e, ["user_id"], "event_id").select("event_id", "offset_us")


def _k4(spark, d):
    return _rounded(V.kappa(_records(spark, d).where("condition = 'off' AND repeat = 1"), "quality", "other", ["category"]), "agreement", "kappa")


def _k5(spark, d):
    return V.confusion(_records(spark, d).where("condition = 'off' AND repeat = 1"), "quality", "other")


def _k6(spark, d):
    return V.stratified_sample(_records(spark, d).select("id", "category").distinct(), "category", 0.15, 3)


def _k7(spark, d):
    x = _records(spark, d).select("id", "number", F.lit("h1").alias("prompt_hash")).distinct()
    done = x.where("number % 3 <> 0").select("id", F.when(F.col("number") % 5 == 0, "h0").otherwise("h1").alias("prompt_hash"), F.when(F.col("number") % 7 == 0, "timeout").alias("error"))
    return V.pending(x, done, ["id", "prompt_hash"]).select("id")


def _k8(spark, d):
    x = _records(spark, d).select("id", "number").distinct()
    old = x.where("number % 2 = 0").select("id", F.lit("old").alias("verdict"))
    return V.upsert(old, x.where("number % 3 = 0").select("id", F.lit("new").alias("verdict")), ["id"])


def _k9(spark, d):
    return _rounded(C.judge_summary(_entries(spark, d), ["condition"]), "declined_rate", "supported_rate", "used_rate", "correct_rate_answerable")


def _k2(spark, d):
    h = _hits(spark, d)
    return C.citation_items(h.where("rank = 2").select("query_id", "source", (F.col("page_start") + 1).alias("page")).distinct(), h)


def _k3(spark, d):
    return C.faithfulness_items(_hits(spark, d), chunks(spark, d).where("length(text) > 60").select("chunk_id", "text"))


def _k10(spark, d):
    return V.batches(_records(spark, d).select("id", "number", "category").distinct(), "number", 10).select("id", "batch")


def _k11(spark, d):
    x = _records(spark, d).where("NOT answerable")
    return x.select("id", "repeat", "condition", C.unanswerable_label(F.col("declined"), F.col("cited")).alias("label"))


def _k12(spark, d):
    x = _records(spark, d).where("condition = 'off' AND repeat = 1").withColumn("one", F.lit(1))
    k = V.kappa(x, "quality", "other", ["one"])
    return k.select("n", F.round("kappa", 6).alias("kappa"), F.when(F.col("kappa") >= 0.8, "pass").otherwise("fail").alias("gate"), (F.col("n") - F.round(F.col("agreement") * F.col("n")).cast("long")).alias("disagreements"))


def _k1(spark, d):
    x = _records(spark, d).where("repeat = 1 AND condition = 'off'")
    golden = load(spark, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("q"), "doc_id").alias("id"), F.array(F.concat("lang", F.lit("/A_"), "doc_id", F.lit(".TXT"))).alias("evidence"))
    return C.correctness_items(x, golden)


def _i1(spark, d):
    x = _records(spark, d)
    calls = _calls(spark, d).groupBy(F.concat(F.lit("q"), "user_id").alias("id")).agg(F.sum("tokens").alias("call_tokens"))
    return x.join(calls, "id", "left").select("id", "repeat", "condition", "cited", "source_hit", F.coalesce("call_tokens", "tokens").alias("tokens"), F.when(F.col("call_tokens").isNull(), "no calls").alias("error"))


_W = lambda ctes, body: f"WITH {ctes} {body}"
_P90 = lambda v, by: f"(SELECT {by}, {v} AS p90 FROM (SELECT {by}, {v}, row_number() OVER (PARTITION BY {by} ORDER BY {v}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM x) WHERE r = floor(0.9 * (n - 1)) + 1)"
QUERIES = {
    "i1_records": (_i1, _W(f"{_R}, {_CALLS}", "SELECT id, repeat, condition, cited, source_hit, coalesce(t, tokens) AS tokens, CASE WHEN t IS NULL THEN 'no calls' END AS error FROM rec LEFT JOIN (SELECT 'q' || user_id AS id, sum(tokens) AS t FROM cal GROUP BY 1) USING (id)")),
    "i2_graded": (_i2, _W(_H, "SELECT query_id, chunk_id, rank, relevance FROM grd")),
    "i3_recall": (
        _i3,
        _W(_H, """, po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(chunk_id), chunk_id) - 1 AS place FROM hit WHERE rank % 3 > 0), ex AS (SELECT query_id, source, min(place) AS place FROM exp LEFT JOIN po USING (query_id, source) GROUP BY ALL)
        SELECT query_id, round(count(*) FILTER (place < 20) / count(*), 6) AS recall_at_20, round(count(*) FILTER (place < 8) / count(*), 6) AS recall_at_8 FROM ex GROUP BY 1"""),
    ),
    "i4_page_sanity": (_i4, "SELECT doc_id AS id, doc_id % 5 + 1 <= ceil(length(text) / 2000) AS pages_ok FROM documents"),
    "i5_best_ranks": (_i5, _W(_H, ", l AS (SELECT query_id, source, min({'rank': r, 'call': c}) AS b FROM (SELECT query_id, source, rank AS r, 1 AS c FROM hit UNION ALL SELECT query_id, source, 20 - rank, 2 FROM hit) GROUP BY ALL) SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY b, source) - 1 AS rank FROM l")),
    "i6_retrieval_metrics": (
        _i6,
        _W(_H.replace("s.chunk_id, rank, score FROM", "s.chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(s.chunk_id), s.chunk_id) - 1 AS rank, score FROM"), """, dc AS (SELECT query_id, source, min(rank) AS rank, max(relevance) AS rel FROM grd WHERE rank < 8 AND relevance > 0 GROUP BY ALL), g AS (SELECT query_id, count(*) AS found, 1 / (min(rank) + 1) AS mrr, sum(rel / log2(rank + 2)) AS dcg FROM dc GROUP BY 1),
        il AS (SELECT query_id, count(*) AS n, sum(CASE WHEN i < 8 THEN best / log2(i + 2) ELSE 0 END) AS ideal FROM (SELECT query_id, best, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, source) - 1 AS i FROM (SELECT query_id, source, CASE WHEN len(pages) > 0 THEN 2 ELSE 1 END AS best FROM exp)) GROUP BY 1)
        SELECT query_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(mrr, 0), 6) AS mrr, round(least(1, coalesce(dcg / ideal, 0)), 6) AS ndcg FROM il LEFT JOIN g USING (query_id)"""),
    ),
    "i7_source_hit": (_i7, _W(_R, "SELECT DISTINCT id, CASE WHEN number % 7 <> 0 THEN CASE WHEN number % 2 = 0 THEN (number % 4 = number % 3 OR true) AND (number % 5 IN (number % 3, number % 4)) ELSE true END END AS hit FROM rec")),
    "i8_subset": (_i8, _W(_R, ", x AS (SELECT DISTINCT id, number FROM rec), w AS (SELECT 'q' || doc_id AS id FROM documents WHERE doc_id % 3 = 0) SELECT id, true AS known, row_number() OVER (ORDER BY number) - 1 AS place FROM x SEMI JOIN w USING (id) UNION ALL SELECT id, false, NULL FROM w ANTI JOIN x USING (id)")),
    "i9_page_hit": (_i9, _W(_H, "SELECT query_id, max(relevance) = 2 AS page_hit, max(CASE WHEN query_id % 3 <> 0 THEN cast(source % 11 = 0 AS INTEGER) END) AS distractor FROM grd WHERE rank < 8 GROUP BY 1")),
    "i10_scorecard": (
        _i10,
        _W(_R, "SELECT condition, repeat, count(*) AS n, round(avg(cast(source_hit AS INTEGER)), 6) AS hit_rate, round(avg(cast(cited AS INTEGER)), 6) AS cited_rate, bool_and(pages_ok) AS all_pages_ok, count(*) FILTER (declined) AS declined, round(median(latency_s), 6) AS latency_median, round(max(latency_s), 6) AS latency_max, cast(sum(tokens) AS BIGINT) AS tokens, round(list_sort(list(latency_s))[cast(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1], 6) AS latency_p90 FROM rec GROUP BY ALL"),
    ),
    "i11_calls_by_purpose": (lambda s, d: _rounded(V.calls_by_purpose(_calls(s, d), ["purpose"]), "ms_median"), _W(_CALLS, "SELECT purpose, count(*) AS calls, cast(sum(tokens) AS BIGINT) AS tokens, round(median(ms), 6) AS ms_median, count(*) FILTER (finish = 'length') AS truncated FROM cal GROUP BY 1")),
    "i12_gates": (_i12, _W(_R, "SELECT condition, category, rung, round(h, 6) AS hit_rate, CASE WHEN h IS NULL THEN 'unknown' WHEN h >= 0.8 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT condition, category, rung, avg(cast(source_hit AS INTEGER)) AS h FROM rec GROUP BY ALL)")),
    "i13_flattened": (lambda s, d: C.flattened(_hits(s, d), 5), _W(_H, "SELECT query_id, source, page_start, page_end, chunk_id, score FROM hit WHERE rank < 5")),
    "i14_trace_rollup": (_i14, _W(_CALLS, "SELECT user_id, date_trunc('day', ts) AS day, cast(sum(tokens) AS BIGINT) AS tokens, round(sum(ms), 4) AS ms, count(*) AS turns FROM cal GROUP BY ALL")),
    "i15_scope_check": (_i15, "SELECT f AS folder, count(*) AS outside FROM (SELECT doc_id * 7 % 200 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS f FROM documents) q WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = q.doc_id AND d.lang = q.f) GROUP BY 1"),
    "i16_index_gate": (
        _i16,
        f"""WITH c AS (SELECT * FROM {CHUNKS}) SELECT count(*) FILTER (chunk_index % 50 = 9) AS no_vector, (SELECT count(*) FROM c WHERE chunk_index % 50 = 7) AS no_chunk, count(*) AS chunks,
        (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE chunk_index % 50 <> 7)) AS empty_documents, (SELECT count(*) FROM c WHERE chunk_index % 50 <> 9) AS vectors, false AS ok FROM c WHERE chunk_index % 50 <> 7
        UNION ALL SELECT 0, 0, count(*), 0, count(*), true FROM c UNION ALL SELECT 0, 0, count(*), 0, count(*), false FROM c""",
    ),
    "i17_manifest": (
        _i17,
        # the tree has as many levels as its rows ask for: the least depth at which 16^depth leaves of 1000 rows hold them
        f"""WITH RECURSIVE {_R}, r AS (SELECT sha256(concat_ws(chr(31), 'answerable=' || answerable, 'category=' || category, 'id=' || id, 'number=' || number)) AS d, count(*) OVER () AS n FROM (SELECT DISTINCT id, number, category, answerable FROM rec)),
  dep AS (SELECT max(n) AS golden_rows, (SELECT min(k) FROM range(60) x(k) WHERE 16.0::DOUBLE ** k * 1000 >= max(n)) AS depth FROM r),
  tree AS (SELECT depth AS level, substr(d, 1, CAST(depth AS INTEGER)) AS p, d || ':1' AS t FROM r, dep
    UNION ALL SELECT level - 1, substr(any_value(p), 1, CAST(level - 1 AS INTEGER)), any_value(p) || ':' || sha256(string_agg(t, ',' ORDER BY t)) FROM tree WHERE level >= 0 GROUP BY level, p),
  g AS (SELECT split_part(t, ':', 2) AS golden_digest, golden_rows FROM tree, dep WHERE level = -1)
  SELECT rung, condition, count(*) AS n, any_value(golden_digest) AS golden_digest, any_value(golden_rows) AS golden_rows, (SELECT count(*) FROM {CHUNKS}) AS index_chunks, 'k=20;keep=12' AS settings FROM rec, g GROUP BY ALL""",
    ),
    "j1_bootstrap": (_j1, _W(f"{_PQ}, {_boot('SELECT condition, id, score AS v FROM pq', 'bt')}", "SELECT * FROM bt")),
    "j2_correctness": (_j2, _W(_PQ, "SELECT condition, count(*) AS questions, round(avg(score), 6) AS rate FROM pq GROUP BY 1")),
    "j3_paired_bootstrap": (_j3, _W(f"{_PQ}, dd AS (SELECT 'delta' AS condition, a.id, b.score - a.score AS v FROM pq a JOIN pq b ON a.id = b.id AND a.condition = 'off' AND b.condition = 'on'), {_boot('SELECT * FROM dd', 'bt')}", "SELECT * FROM bt")),
    "j4_mcnemar": (_j4, f"SELECT b, c, round({_MC}, 6) AS p FROM (SELECT DISTINCT s_suppkey % 40 AS b, s_suppkey * 7 % 30 AS c FROM supplier)"),
    "j5_comparison": (
        _j5,
        _W(_R, f", q AS (SELECT condition, id, avg(score) AS s, 2 * sum(score) > count(*) AS g FROM rec WHERE answerable AND score IS NOT NULL GROUP BY ALL), r AS (SELECT count(*) AS common, round(avg(y.s - x.s), 6) AS delta, count(*) FILTER (x.g AND NOT y.g) AS b, count(*) FILTER (y.g AND NOT x.g) AS c FROM q x JOIN q y ON x.id = y.id AND x.condition = 'off' AND y.condition = 'on') SELECT common, delta, b AS only_a, c AS only_b, round({_MC}, 6) AS p FROM r"),
    ),
    "j6_config_summary": (
        _j6,
        _W(_R, f""", {_E}, {_WM}, q AS (SELECT condition, id, avg(cast(label = 'correct' AS INTEGER)) AS m FROM ent WHERE answerable AND label IS NOT NULL GROUP BY ALL), a AS (SELECT condition, {_JUDGED} FROM ent GROUP BY 1),
  h AS (SELECT condition, round(avg(h), 6) AS source_hit_rate, count(*) AS repeats FROM (SELECT condition, repeat, avg(cast(source_hit AS INTEGER)) AS h FROM rec GROUP BY ALL) GROUP BY 1),
  m AS (SELECT condition, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) FILTER (declined) AS declined_answers, round(avg(tokens), 6) AS tokens FROM wm GROUP BY 1)
  SELECT * FROM a JOIN h USING (condition) JOIN m USING (condition) JOIN (SELECT condition, round(avg(m), 6) AS correct_rate, count(*) AS judged FROM q GROUP BY 1) USING (condition)"""),
    ),
    "j6_category_rates": (
        _j6_categories,
        _W(_R, f""", {_E}, {_WM}, q AS (SELECT condition, category, id, avg(cast(label = 'correct' AS INTEGER)) AS m FROM ent WHERE answerable AND label IS NOT NULL GROUP BY ALL)
  SELECT * FROM (SELECT condition, category, round(avg(recall), 6) AS recall FROM wm GROUP BY ALL) LEFT JOIN (SELECT condition, category, round(avg(m), 6) AS correct_rate, count(*) AS questions FROM q GROUP BY ALL) USING (condition, category)"""),
    ),
    "j7_latency": (_j7, _W(_R + ", x AS (SELECT * FROM rec)", f"SELECT condition, round(median(latency_s), 6) AS median, round(avg(tokens), 6) AS tokens, round(avg(reasoning), 6) AS reasoning, round(any_value(p90), 6) AS p90 FROM rec JOIN {_P90('latency_s', 'condition')} USING (condition) GROUP BY 1")),
    "j8_cost": (_j8, _W(_R, ", x AS (SELECT condition, repeat, count(*) AS n, sum(latency_s) AS s FROM rec GROUP BY ALL) SELECT condition, CASE WHEN condition = 'on' THEN round(2.0 / 3600 * avg(s / n) * 1000, 6) END AS sequential, CASE WHEN condition = 'on' THEN round(2.0 / (max(n * 60 / s) * 60) * 1000, 6) END AS concurrent FROM x GROUP BY 1")),
    "j9_load_levels": (
        _j9,
        _W(_CALLS, """, y AS (SELECT *, user_id % 3 AS concurrency, purpose = 'error' AS error, ms * (user_id % 5 + 1) / 8 AS first_ms, CASE WHEN ms <> 0 THEN tokens * 1000 / ms END AS rate FROM cal),
  z AS (SELECT *, CASE WHEN ms > first_ms THEN tokens * 1000 / (ms - first_ms) END AS dec FROM y)
  SELECT concurrency, count(*) FILTER (NOT error) AS ok, count(*) FILTER (error) AS errors, round(max(ms) FILTER (NOT error), 6) AS max,
    round(count(*) FILTER (NOT error) / ((max(epoch_us(ts) / 1000 + ms) - min(epoch_us(ts) / 1000)) / 60000), 6) AS per_minute, """
           + ", ".join(f"round(median({v}) FILTER (NOT error), 6) AS {n}median, round(list_sort(list({v}) FILTER (NOT error AND {v} IS NOT NULL))[cast(floor(0.9 * (count({v}) FILTER (NOT error) - 1)) AS BIGINT) + 1], 6) AS {n}p90" for v, n in (("ms", ""), ("rate", "rate_"), ("first_ms", "first_"), ("dec", "decode_")))
           + " FROM z GROUP BY 1"),
    ),
    "j10_spend": (_j10, "SELECT coalesce('r' || r, 'total') AS rung, round(sum(value), 4) AS cost, sum(value) <= 1000 AS within FROM (SELECT user_id % 6 AS r, value FROM events WHERE event_type = 'purchase') GROUP BY ROLLUP (r)"),
    "j10_running_spend": (_j10_running, "SELECT event_id AS number, cast(sum(round(value * 100)::BIGINT) OVER w AS BIGINT) AS spent, sum(round(value * 100)::BIGINT) OVER w <= 1000000 AS within FROM events WHERE event_type = 'purchase' WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"),
    "j11_call_metrics": (
        _j11,
        _W(_CALLS, """ SELECT CASE WHEN purpose IN ('view', 'click') THEN 'answer' ELSE 'side' END AS kind, count(*) AS calls, cast(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (finish = 'length') AS truncated,
  round(median(CASE WHEN ms <> 0 THEN tokens * 1000 / ms END), 6) AS rate_median, round(median(ms), 6) AS ms_median, round(sum(tokens) / (SELECT count(DISTINCT user_id) FROM cal), 6) AS tokens_per_question, 'calls' AS source FROM cal GROUP BY 1"""),
    ),
    "j11_approximate": (
        _j11_approximate,
        _W(_R, """, x AS (SELECT *, CASE WHEN number % 9 > 0 THEN latency_s * 700 END AS ams FROM rec) SELECT condition, rung, round(avg(coalesce(reasoning, 0)), 6) AS reasoning_per_question, round(median(CASE WHEN ams > 1 THEN tokens * 1000 / ams END), 6) AS rate_median,
  round(median(CASE WHEN ams > 0 THEN ams END), 6) AS ms_median, 'approx' AS source FROM x GROUP BY ALL"""),
    ),
    "j12_pairing": (_j12, _W(_PQ, ", m AS (SELECT rung, condition, avg(score) AS m FROM pq JOIN (SELECT DISTINCT id, rung FROM rec) USING (id) GROUP BY ALL) SELECT rung, round(max(m) FILTER (condition = 'off'), 6) AS off, round(max(m) FILTER (condition = 'on'), 6) AS on, round(max(m) FILTER (condition = 'on') - max(m) FILTER (condition = 'off'), 6) AS delta, list_position(['r1', 'r0'], rung) AS place FROM m GROUP BY rung")),
    "j13_stability": (_j13, _W(_R, "SELECT condition, count(*) FILTER (k = 1) AS stable, count(*) AS questions, round(avg(m), 6) AS share FROM (SELECT condition, id, count(DISTINCT score) AS k, avg(score) AS m FROM rec WHERE score IS NOT NULL GROUP BY ALL) GROUP BY 1")),
    "j13_verdict_mix": (
        _j13_mix,
        _W(f"{_R}, {_E}, hq AS (SELECT condition, id, avg(CASE label WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM ent WHERE answerable AND label IS NOT NULL GROUP BY ALL), {_boot('SELECT * FROM hq', 'bt')}",
           ", a AS (SELECT * FROM ent WHERE answerable AND label IS NOT NULL), s AS (SELECT condition, count(*) FILTER (k = 1) AS stable FROM (SELECT condition, id, count(DISTINCT label) AS k FROM a GROUP BY ALL) GROUP BY 1), v AS (SELECT condition, "
           + ", ".join(f"round(count(*) FILTER (label = '{x}') / count(*), 6) AS {x}_share" for x in ("correct", "partial", "wrong", "abstained")) + " FROM a GROUP BY 1) SELECT * FROM v JOIN s USING (condition) JOIN bt USING (condition)"),
    ),
    "j14_question_matrix": (
        _j14,
        _W(_R, f""", {_E}, c AS (SELECT id, condition, md5(string_agg(concat_ws('|', repeat, coalesce(label, '-'), substr(concat_ws(' ', 'Judged', label, repeat('because ', number % 70)), 1, 400), md5(substr(trim(coalesce(text, ''), ' '), 1, 900)), 'd' || number % 5 || '+' || category, round(latency_s, 2)), '#' ORDER BY repeat)) AS x
  FROM ent JOIN documents d ON d.doc_id = number GROUP BY ALL) SELECT id, max(x) FILTER (condition = 'off') AS off, max(x) FILTER (condition = 'on') AS on FROM c GROUP BY 1"""),
    ),
    "j15_diagnosis": (_j15, "WITH p AS (SELECT event_type AS cause, count(*) AS k FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4 DESC, event_id DESC) = 1) GROUP BY 1) SELECT event_type AS cause, count(DISTINCT user_id) AS any_n, coalesce(any_value(k), 0) AS primary_n FROM events LEFT JOIN p ON cause = event_type GROUP BY 1"),
    "j16_reasoning": (_j16, _W(_R, ", x AS MATERIALIZED (SELECT condition, score, reasoning FROM rec) SELECT condition, score, round(median(reasoning), 6) AS median FROM x WHERE reasoning > 0 AND score IS NOT NULL GROUP BY condition, score")),
    "j17_balanced_subset": (_j17, _W(_R, ", x AS (SELECT DISTINCT id, number, category FROM rec WHERE category <> 'fr') SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY number, id) AS t FROM x) ORDER BY t, category LIMIT 24")),
    "j18_rung_summary": (_j18, _W(_R, "SELECT rung, condition, round(avg(l), 6) AS latency, round(avg(t), 6) AS tokens FROM (SELECT rung, condition, repeat, avg(latency_s) AS l, sum(tokens) AS t FROM rec GROUP BY ALL) GROUP BY ALL")),
    "j19_config_key": (_j19, _W(_R, "SELECT rung || '/' || condition || CASE WHEN k > 1 THEN '@' || gpu ELSE '' END AS config, count(*) AS n FROM rec JOIN (SELECT rung, condition, count(DISTINCT gpu) AS k FROM rec GROUP BY ALL) USING (rung, condition) GROUP BY 1")),
    "j20_boot_timeline": (_j20, "SELECT event_id, epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS offset_us FROM events"),
    "k1_correctness_items": (_k1, _W(_R, "SELECT id, category, CASE WHEN number % 3 <> 0 THEN 'a_' || number || '.txt' END AS evidence FROM rec WHERE repeat = 1 AND condition = 'off'")),
    "k2_citation_items": (_k2, _W(_H, ", ct AS (SELECT DISTINCT query_id, source, page_start + 1 AS page FROM hit WHERE rank = 2) SELECT query_id, source, page, arg_min(chunk_id, rank) AS chunk_id FROM ct LEFT JOIN hit USING (query_id, source) WHERE page BETWEEN page_start AND page_end GROUP BY ALL")),
    "k3_faithfulness_items": (_k3, _W(_H, "SELECT query_id, string_agg((rank + 1) || '.' || c.text, '|' ORDER BY rank) AS passages FROM hit JOIN c USING (chunk_id) WHERE rank < 8 AND length(c.text) > 60 GROUP BY 1")),
    "k4_kappa": (_k4, _W(_R, """, x AS (SELECT category, quality AS a, other AS b FROM rec WHERE condition = 'off' AND repeat = 1), t AS (SELECT category, count(*) AS n, avg(cast(a = b AS INTEGER)) AS po, (sum(a) * sum(b) + (count(*) - sum(a)) * (count(*) - sum(b))) / (count(*) * count(*)) AS pe FROM x GROUP BY 1)
        SELECT category, n, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM t""")),
    "k5_confusion": (_k5, _W(_R, ", x AS (SELECT quality, other FROM rec WHERE condition = 'off' AND repeat = 1), l AS (SELECT quality AS l FROM x UNION SELECT other FROM x) SELECT a.l AS quality, b.l AS other, (SELECT count(*) FROM x WHERE x.quality = a.l AND x.other = b.l) AS n FROM l a, l b")),
    "k6_stratified_sample": (_k6, _W(_R, ", x AS (SELECT DISTINCT id, category FROM rec) SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('3:' || id), id) AS r, count(*) OVER (PARTITION BY category) AS n FROM x) WHERE r <= greatest(1, round_even(n * 0.15, 0))")),
    "k7_pending": (_k7, _W(_R, "SELECT DISTINCT id FROM rec WHERE NOT (number % 3 <> 0 AND number % 5 <> 0 AND number % 7 <> 0)")),
    "k8_upsert": (_k8, _W(_R, "SELECT DISTINCT id, CASE WHEN number % 3 = 0 THEN 'new' ELSE 'old' END AS verdict FROM rec WHERE number % 2 = 0 OR number % 3 = 0")),
    "k9_judge_summary": (
        _k9,
        _W(_R, f""", {_E} SELECT condition, category, {_JUDGED}, count(*) FILTER (answerable) AS answerable, round(count(*) FILTER (answerable AND label = 'correct') / nullif(count(*) FILTER (answerable), 0), 6) AS correct_rate_answerable
  FROM ent GROUP BY GROUPING SETS ((condition, category), (condition))"""),
    ),
    "k10_batches": (_k10, _W(_R, "SELECT id, (row_number() OVER (PARTITION BY category ORDER BY number) - 1) // 10 AS batch FROM (SELECT DISTINCT id, number, category FROM rec)")),
    "k11_unanswerable": (_k11, _W(_R, "SELECT id, repeat, condition, CASE WHEN declined AND cited THEN 'declined' ELSE 'answered_wrong' END AS label FROM rec WHERE NOT answerable")),
    "k12_calibration": (_k12, _W(_R, ", x AS (SELECT quality AS a, other AS b FROM rec WHERE condition = 'off' AND repeat = 1), t AS (SELECT count(*) AS n, avg(cast(a = b AS INTEGER)) AS po, (sum(a) * sum(b) + (count(*) - sum(a)) * (count(*) - sum(b))) / (count(*) * count(*)) AS pe, count(*) FILTER (a <> b) AS dis FROM x) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.8 THEN 'pass' ELSE 'fail' END AS gate, dis AS disagreements FROM t")),
}
