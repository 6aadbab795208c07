"""Campaigns of runs: roll-ups of records and calls, pairings, matrices, gates of an index, and the items that judges grade.

Records have id, rung, condition, repeat, category, answerable, declined, score (null: not graded), latency_s, tokens, reasoning.
Means and medians skip nulls; a group without values has a null. Hits have query_id, source, page_start, page_end, chunk_id, rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.evaluation import bootstrap
from folioscope.operators.order import order_statistics, running_sum, table_digest


def _n() -> Column:
    return F.count(F.lit(1))


#: Verdicts (fixed values) of answers to answerable questions and to the others; what a verdict counts where half credit is given.
VERDICTS, UNANSWERABLE = ("correct", "partial", "wrong", "abstained"), ("declined", "answered_wrong")
HALF = 0.5


def _yes(flags: str) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def _judged() -> list[Column]:
    """Counts and rates of judge entries: verdicts, claims that are supported, citations that are used."""
    known, label = F.col("answerable"), F.col("label")
    count = lambda name, kind: F.count_if(kind & (label == name)).alias(name)
    claims, cited = F.coalesce(F.sum(F.greatest(F.size("claims"), F.lit(0))), F.lit(0)), F.coalesce(F.sum(F.greatest(F.size("citations"), F.lit(0))), F.lit(0))
    return [
        *[count(v, known) for v in VERDICTS], *[count(v, ~known) for v in UNANSWERABLE], F.count_if(~known & label.isNotNull()).alias("unanswerable"), F.count_if(label.isNull()).alias("ungraded"),
        F.try_divide(F.count_if(~known & (label == "declined")), F.count_if(~known & label.isNotNull())).alias("declined_rate"),
        claims.alias("claims"), F.try_divide(F.sum(F.greatest(_yes("claims"), F.lit(0))), claims).alias("supported_rate"), cited.alias("citations"), F.try_divide(F.sum(F.greatest(_yes("citations"), F.lit(0))), cited).alias("used_rate"),
    ]


def question_means(entries: DataFrame, by: list[str], partial: float = 0.0) -> DataFrame:
    """(by, id, score): each answerable, judged question's mean over repeats; a partial answer counts so much."""
    score = F.when(F.col("label") == "correct", 1.0).when(F.col("label") == "partial", partial).otherwise(0.0)
    return entries.where("answerable AND label IS NOT NULL").groupBy(*by, "id").agg(F.avg(score).alias("score"))


def config_summary(records: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """A configuration's headline numbers: what judges said (entries: by, id, repeat, category, answerable, label, claims, citations; the last two are arrays of
    booleans), the mean of its runs' hit rates, means of retrieval metrics, and the mean score of its questions."""
    runs = records.groupBy(*by, "repeat").agg(F.avg(F.col("source_hit").cast("int")).alias("hit"))
    hits = runs.groupBy(*by).agg(F.avg("hit").alias("source_hit_rate"), _n().alias("repeats"))
    means = records.groupBy(*by).agg(F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.count_if("declined").alias("declined_answers"), F.avg("tokens").alias("tokens"))
    right = question_means(entries, by).groupBy(*by).agg(F.avg("score").alias("correct_rate"), _n().alias("judged"))
    return entries.groupBy(*by).agg(*_judged()).join(hits, by, "left").join(means, by, "left").join(right, by, "left")


def category_rates(records: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """By category too: the mean of the questions' means, and the mean recall."""
    keys = [*by, "category"]
    recall = records.groupBy(*keys).agg(F.avg("recall").alias("recall"))
    return recall.join(question_means(entries, keys).groupBy(*keys).agg(F.avg("score").alias("correct_rate"), _n().alias("questions")), keys, "left")


def latencies(records: DataFrame, by: list[str]) -> DataFrame:
    """Median and 90th order statistic of latency, mean tokens and reasoning."""
    means = records.groupBy(*by).agg(F.avg("tokens").alias("tokens"), F.avg("reasoning").alias("reasoning"))
    return means.join(order_statistics(records, by, "latency_s", {"median": 0.5, "p90": 0.9}, ("median",)), by)


def costs(records: DataFrame, rate_per_hour: Column) -> DataFrame:
    """Cost of 1,000 questions for each condition: one after another, and at the best rate per minute of its repeats."""
    runs = records.groupBy("condition", "repeat").agg(_n().alias("n"), F.sum("latency_s").alias("s"))
    per = runs.groupBy("condition").agg(F.avg(F.col("s") / F.col("n")).alias("seconds"), F.max(F.col("n") * 60 / F.col("s")).alias("best"))
    return per.select("condition", (rate_per_hour / 3600 * F.col("seconds") * 1000).alias("sequential"), (rate_per_hour / (F.col("best") * 60) * 1000).alias("concurrent"))


def load_levels(calls: DataFrame) -> DataFrame:
    """Calls (concurrency, error, ms, tokens, started, first_ms) by level: good and failed ones and these a minute of the level's time; of good ones
    the median, 90th order statistic and largest latency, the median and 90th of tokens a second, of the time to the first token, and of tokens a second after it."""
    good = calls.where("NOT error").withColumns({"_rate": F.try_divide(F.col("tokens") * 1000, F.col("ms")), "_decode": F.try_divide(F.col("tokens") * 1000, F.when(F.col("ms") > F.col("first_ms"), F.col("ms") - F.col("first_ms")))})
    wall = (F.max(F.unix_micros("started") / 1000 + F.col("ms")) - F.min(F.unix_micros("started") / 1000)) / 60000
    rows = calls.groupBy("concurrency").agg(F.count_if(~F.col("error")).alias("ok"), F.count_if("error").alias("errors"), F.max(F.when(~F.col("error"), F.col("ms"))).alias("max"), F.try_divide(F.count_if(~F.col("error")), wall).alias("per_minute"))
    for value, name in (("ms", ""), ("_rate", "rate_"), ("first_ms", "first_"), ("_decode", "decode_")):
        rows = rows.join(order_statistics(good, ["concurrency"], value, {f"{name}median": 0.5, f"{name}p90": 0.9}, (f"{name}median",)), "concurrency", "left")
    return rows


def spend(ledger: DataFrame, limit: float) -> DataFrame:
    """Cost of each rung and in total (rung 'total'), and whether it is within the limit."""
    sums = ledger.rollup("rung").agg(F.sum("cost").alias("cost"))
    return sums.select(F.coalesce("rung", F.lit("total")).alias("rung"), "cost", (F.col("cost") <= limit).alias("within"))


def spent_so_far(ledger: DataFrame, limit: float) -> DataFrame:
    """ledger (at, number, cost) with the sum up to each entry, and whether that is within the limit. Ranges are summed apart."""
    return running_sum(ledger, "cost", "spent", F.col("at"), F.col("number")).withColumn("within", F.col("spent") <= limit)


def call_metrics(calls: DataFrame, answering: list[str]) -> DataFrame:
    """Calls (id, purpose, tokens, ms, finish) that answer, and side calls: how many, tokens, tokens a question (of all questions with calls), medians of tokens a
    second and of ms, and answers that were cut."""
    kind = F.when(F.col("purpose").isin(answering), "answer").otherwise("side")
    rows = calls.withColumns({"kind": kind, "_rate": F.try_divide(F.col("tokens") * 1000, F.col("ms"))})
    questions = calls.agg(F.count_distinct("id").alias("questions"))  # one row
    sums = rows.groupBy("kind").agg(_n().alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(F.col("finish") == "length").alias("truncated"))
    for value, name in (("_rate", "rate_median"), ("ms", "ms_median")):
        sums = sums.join(order_statistics(rows, ["kind"], value, {name: 0.5}, (name,)), "kind", "left")
    return sums.crossJoin(questions).withColumn("tokens_per_question", F.try_divide("tokens", "questions")).drop("questions").withColumn("source", F.lit("calls"))


def approximate_call_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """The same of records without calls (tokens, answer_ms, reasoning), as far as it can be told: the answer's rate from all tokens and its stage's time."""
    rows = records.withColumn("_rate", F.when(F.col("answer_ms") > 1, F.col("tokens") * 1000 / F.col("answer_ms"))).withColumn("_ms", F.when(F.col("answer_ms") > 0, F.col("answer_ms")))
    out = rows.groupBy(*by).agg(F.avg(F.coalesce("reasoning", F.lit(0))).alias("reasoning_per_question"))
    for value, name in (("_rate", "rate_median"), ("_ms", "ms_median")):
        out = out.join(order_statistics(rows, by, value, {name: 0.5}, (name,)), by, "left")
    return out.withColumn("source", F.lit("approx"))


def paired_conditions(scores: DataFrame, off: str, on: str, rungs: list[str]) -> DataFrame:
    """Mean scores (rung, condition, score) of two conditions side by side; place: the rung's place in the order given, 0 if not in it."""
    wide = scores.where(F.col("condition").isin(off, on)).groupBy("rung").agg(*[F.avg(F.when(F.col("condition") == c, F.col("score"))).alias(name) for c, name in ((off, "off"), (on, "on"))])
    return wide.select("rung", "off", "on", (F.col("on") - F.col("off")).alias("delta"), F.array_position(F.array(*map(F.lit, rungs)), F.col("rung")).alias("place"))


def stability(records: DataFrame) -> DataFrame:
    """For each condition: questions whose repeats all have one score, questions, and the mean of the questions' means."""
    questions = records.where("score IS NOT NULL").groupBy("condition", "id").agg((F.min("score") == F.max("score")).alias("same"), F.avg("score").alias("m"))
    return questions.groupBy("condition").agg(F.count_if("same").alias("stable"), _n().alias("questions"), F.avg("m").alias("share"))


def verdict_mix(entries: DataFrame, by: list[str], samples: int = 10_000) -> DataFrame:
    """Shares of verdicts of answerable, judged answers; the mean of the questions' means with half credit, with its interval of resamples; questions whose
    repeats all have one verdict."""
    rows = entries.where("answerable AND label IS NOT NULL")
    shares = rows.groupBy(*by).agg(*[(F.count_if(F.col("label") == v) / _n()).alias(f"{v}_share") for v in VERDICTS])
    same = rows.groupBy(*by, "id").agg((F.count_distinct("label") == 1).alias("same")).groupBy(*by).agg(F.count_if("same").alias("stable"))
    return shares.join(same, by).join(bootstrap(question_means(entries, by, HALF), by, "score", samples), by)


def question_matrix(records: DataFrame, entries: DataFrame, config: str, reason: int = 400, answer: int = 900) -> DataFrame:
    """(id, cells): for each question a map from its configurations to what their repeats gave, in order: repeat, label, reason and answer (cut), cited, latency_s.

    records: id, repeat, config, answer, cited (array), latency_s; entries: id, repeat, config, label, reason. A question has as many cells as configurations and repeats."""
    said = entries.select("id", config, "repeat", "label", "reason")
    rows = records.select("id", config, "repeat", "answer", "cited", "latency_s").join(said, ["id", config, "repeat"], "left")
    cut = [F.substring(F.coalesce("reason", F.lit("")), 1, reason).alias("reason"), F.substring(F.trim(F.coalesce("answer", F.lit(""))), 1, answer).alias("answer")]
    cell = F.struct("repeat", "label", *cut, "cited", "latency_s")
    cells = rows.groupBy("id", config).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return cells.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(config, "cells")))).alias("cells"))


def diagnosis(found: DataFrame) -> DataFrame:
    """Causes found (id, cause, rung, number): of how many questions it is the primary one (the latest rung's last), and any one."""
    last = found.groupBy("id").agg(F.max_by("cause", F.struct("rung", "number")).alias("cause"))
    every = found.select("id", "cause").distinct().groupBy("cause").agg(_n().alias("any_n"))
    return every.join(last.groupBy("cause").agg(_n().alias("primary_n")), "cause", "left").na.fill(0, ["primary_n"])


def reasoning_lengths(records: DataFrame) -> DataFrame:
    """Median length of reasoning by condition and score, of graded records that reasoned."""
    return records.where("reasoning > 0 AND score IS NOT NULL").groupBy("condition", "score").agg(F.median("reasoning").alias("median"))


def rung_summary(records: DataFrame) -> DataFrame:
    """Means over repeats of each rung's and condition's mean latency and tokens."""
    runs = records.groupBy("rung", "condition", "repeat").agg(F.avg("latency_s").alias("l"), F.sum("tokens").alias("t"))
    return runs.groupBy("rung", "condition").agg(F.avg("l").alias("latency"), F.avg("t").alias("tokens"))


def boot_timeline(steps: DataFrame, by: list[str], number: str) -> DataFrame:
    """steps (ts, number) with offset_us from the first step of the same boot."""
    first = F.first("ts").over(Window.partitionBy(*by).orderBy("ts", number))
    return steps.withColumn("offset_us", F.unix_micros("ts") - F.unix_micros(first))


def pages_ok(cited: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether all cited pages (id, doc_id, page) exist in their documents (doc_id, page_count)."""
    return cited.join(documents.select("doc_id", "page_count"), "doc_id", "left").groupBy("id").agg(F.bool_and(F.col("page") <= F.col("page_count")).alias("pages_ok"))


def page_hits(graded: DataFrame, distractor: Column, k: int = 8) -> DataFrame:
    """Whether an expected page is among the first k, and the largest of distractor (null: none is listed for the query)."""
    return graded.where(F.col("rank") < k).groupBy("query_id").agg((F.max("relevance") == 2).alias("page_hit"), F.max(distractor).alias("distractor"))


def flattened(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of each query, a row each."""
    return hits.where(F.col("rank") < k).select("query_id", "source", "page_start", "page_end", "chunk_id", "score")


def trace_rollup(calls: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, milliseconds and number of calls of a turn."""
    return calls.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), _n().alias("turns"))


def outside_scope(cited: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """How many cited documents (doc_id, scope) aren't members (doc_id, scope) of the scope asked for; scopes without any are left out."""
    return cited.join(members, ["doc_id", scope], "left_anti").groupBy(scope).agg(_n().alias("outside"))


def index_gate(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, recorded: int | None = None) -> DataFrame:
    """One row: chunks without vector, vectors without chunk, chunks, documents without chunk, vectors, and ok: whether nothing is missing and as many vectors are there as
    were recorded when the index was made (null: it isn't known)."""
    both = chunks.select("chunk_id").join(vectors.select(F.col("chunk_id").alias("_v")), F.col("chunk_id") == F.col("_v"), "full_outer")
    sides = both.agg(F.count_if(F.col("_v").isNull()).alias("no_vector"), F.count_if(F.col("chunk_id").isNull()).alias("no_chunk"), F.count("chunk_id").alias("chunks"))
    empty = documents.select("doc_id").join(chunks, "doc_id", "left_anti").agg(_n().alias("empty_documents"))
    both = sides.crossJoin(empty).crossJoin(vectors.agg(_n().alias("vectors")))  # of one row each
    whole = F.col("no_vector") + F.col("no_chunk") + F.col("empty_documents") == 0
    return both.withColumn("ok", whole & (F.lit(True) if recorded is None else F.col("vectors") == recorded))


def with_manifest(records: DataFrame, by: list[str], golden: DataFrame, **facts) -> DataFrame:
    """Records of each run, the digest and number of whole golden rows, and given facts (settings, sizes of an index, ids of a subset: values of the run)."""
    stamped = table_digest(golden).select(F.col("digest").alias("golden_digest"), F.col("rows").alias("golden_rows"), *[F.lit(v).alias(k) for k, v in facts.items()])
    return records.groupBy(*by).agg(_n().alias("n")).crossJoin(stamped)  # of one row


def correctness_items(records: DataFrame, golden: DataFrame) -> DataFrame:
    """What a judge of correctness reads: records with the evidence (id, evidence: paths) of their questions, as file names, joined by commas."""
    names = F.transform("evidence", lambda p: F.lower(F.regexp_extract(p, r"([^/\\]*)$", 1)))
    return records.select("id", "category").join(golden.select("id", "evidence"), "id", "left").select("id", "category", F.array_join(names, ",").alias("evidence"))


def citation_items(cited: DataFrame, hits: DataFrame) -> DataFrame:
    """Each cited page (query_id, source, page) with the first hit that covers it, null if none does."""
    keys = ["query_id", "source", "page"]
    covering = cited.join(hits, keys[:2]).where("page BETWEEN page_start AND page_end").groupBy(*keys).agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return cited.join(covering, keys, "left")


def faithfulness_items(hits: DataFrame, texts: DataFrame, k: int = 8) -> DataFrame:
    """The first k hits' texts (chunk_id, text) of each query, numbered by rank from 1 and joined by '|'."""
    rows = hits.where(F.col("rank") < k).join(texts, "chunk_id")
    found = F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("t"))))  # k at most
    return rows.groupBy("query_id").agg(F.array_join(F.transform(found, lambda x: F.concat((x["rank"] + 1).cast("string"), F.lit("."), x["t"])), "|").alias("passages"))


def judge_summary(entries: DataFrame, by: list[str]) -> DataFrame:
    """Verdict counts, rates of claims and citations, and the rate of correct answers over *all* answerable entries, graded or not: for each group of by, and (category
    null) over all categories of one."""
    rate = F.try_divide(F.count_if(F.col("answerable") & (F.col("label") == "correct")), F.count_if("answerable")).alias("correct_rate_answerable")
    every = [*_judged(), F.count_if("answerable").alias("answerable"), rate]
    whole = entries.groupBy(*by).agg(*every).withColumn("category", F.lit(None).cast("string"))
    return entries.groupBy(*by, "category").agg(*every).unionByName(whole)


def unanswerable_label(declined: Column, cited: Column) -> Column:
    """The verdict of an answer to an unanswerable question."""
    return F.when(declined & cited, "declined").otherwise("answered_wrong")
