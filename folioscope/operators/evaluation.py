"""Evaluation of answers: per-question metrics, run scorecards, campaign statistics, judges.

A metric is null where nothing was expected; means skip nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.order import order_statistics, placed
from folioscope.operators.resampling import resampled
from folioscope.operators.retrieval import ranked, small
from folioscope.plans.tables import stored


def graded(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits (query_id, source, page_start, page_end, rank) with relevance: 2 on an expected page, 1 of an expected document, else
    0; expected: query_id, source, pages (null or empty: any page is 1)."""
    e = expected.select("query_id", "source", "pages", F.lit(1).alias("_known"))
    on_page = F.coalesce(F.exists("pages", lambda p: p.between(F.col("page_start"), F.col("page_end"))), F.lit(False))
    return hits.join(e, ["query_id", "source"], "left").withColumn("relevance", F.when(on_page, 2).when(F.col("_known") == 1, 1).otherwise(0)).drop("pages", "_known")


def best_ranks(lists: DataFrame, key: list[str]) -> DataFrame:
    """Lists (query_id, call, rank, key) as one, by best rank, ties by call."""
    best = lists.groupBy("query_id", *key).agg(F.min(F.struct("rank", "call")).alias("b"))
    return ranked(best, ["query_id"], F.col("b.rank"), F.col("b.call"), *map(F.col, key)).drop("b")


def retrieval_metrics(hits: DataFrame, expected: DataFrame, k: int = 8) -> DataFrame:
    """recall_k, mrr and ndcg of hits (query_id, source, rank, relevance) for queries of expected (query_id, source, best):
    per document its first rank and best relevance; the ideal has expected documents by their best relevance."""
    top = hits.where(F.col("rank") < k)
    docs = top.where("relevance > 0").groupBy("query_id", "source").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    got = docs.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), (1 / (F.min("rank") + 1)).alias("mrr"), F.sum(F.col("relevance") / F.log2(F.col("rank") + 2)).alias("dcg"))
    ideal = ranked(expected, ["query_id"], F.desc("best"), F.col("source"), name="_i").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_i") < k, F.col("best") / F.log2(F.col("_i") + 2)).otherwise(0.0)).alias("ideal")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query_id", "left").select("query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(F.col("mrr")).alias("mrr"), F.least(F.lit(1.0), zero(F.col("dcg") / F.col("ideal"))).alias("ndcg"))


def source_hit(cited: Column, expected: Column, match: Column) -> Column:
    """Whether any (or all) expected sources are cited; null if none is expected."""
    return F.when(F.size(expected) > 0, F.when(match == "all", F.size(F.array_except(expected, cited)) == 0).otherwise(F.arrays_overlap(expected, cited)))


def scorecard(records: DataFrame, by: list[str]) -> DataFrame:
    """A run's rates over what isn't null, medians and 90th order statistics."""
    rows = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("source_hit").cast("int")).alias("hit_rate"), F.avg(F.col("cited").cast("int")).alias("cited_rate"), F.bool_and("pages_ok").alias("all_pages_ok"),
        F.count_if("declined").alias("declined"), F.max("latency_s").alias("latency_max"), F.sum("tokens").alias("tokens"),
    )
    return rows.join(order_statistics(records, by, "latency_s", {"latency_median": 0.5, "latency_p90": 0.9}, ("latency_median",)), by, "left")


def calls_by_purpose(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.median("ms").alias("ms_median"), F.count_if(F.col("finish") == "length").alias("truncated"))


def gate(df: DataFrame, value: str, least: float) -> DataFrame:
    return df.withColumn("status", F.when(F.col(value).isNull(), "unknown").when(F.col(value) >= least, "pass").otherwise("fail"))


def per_question(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean over repeats of answerable, judged answers: by, id, score."""
    return scores.where("answerable AND score IS NOT NULL").groupBy(*by, "id").agg(F.avg("score").alias("score"))


def bootstrap(rows: DataFrame, by: list[str], value: str, samples: int = 10_000, seed: int = 7) -> DataFrame:
    """by, n, mean, low and high: the 2.5 and 97.5 percentiles (interpolated) of means of resamples; a draw is the md5 of seed, sample
    and slot modulo n, so that any engine draws the same. Draws are made in resampling.py, none is a row."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    numbered = stored(placed(rows.select(*by, "id", F.col(value).alias("_v")), by, F.col("id"), name="_i").join(small(sizes), by).select(*by, "_i", "_n", "_v"))
    means = resampled(numbered, by, samples, seed)
    bounds = means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean")).join(bounds, by)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs: min(1, 2 * sum of C(n, i) / 2^n up to min(b, c)); 1 without any."""
    n = (b + c).cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(
        F.sequence(F.lit(0), F.least(b, c).cast("int")), start,
        lambda s, i: F.struct((s["term"] * (n - i) / (i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")), lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * walked))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of common questions of a and b (id, mean, good, n; good: correct repeats): delta, only_a and only_b by majority (a tie isn't correct), p."""
    both = a.select("id", F.col("score").alias("x"), (2 * F.col("good") > F.col("n")).alias("p")).join(b.select("id", F.col("score").alias("y"), (2 * F.col("good") > F.col("n")).alias("q")), "id")
    one = both.agg(F.count(F.lit(1)).alias("common"), F.avg(F.col("y") - F.col("x")).alias("delta"), F.count_if(F.col("p") & ~F.col("q")).alias("only_a"), F.count_if(F.col("q") & ~F.col("p")).alias("only_b"))
    return one.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def kappa(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Cohen's kappa of two raters; null without rows, 1 if the agreement expected is 1."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_c"))
    total = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("_l")).agg(F.sum("_c").alias("_p"))
    right = cells.groupBy(*by, F.col(b).alias("_l")).agg(F.sum("_c").alias("_q"))
    chance = left.join(right, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_p") * F.col("_q")).alias("_s"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("_s", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, by, "left").select(*by, "n", po.alias("agreement"), F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over all labels that either rater gave, zeros too."""
    labels = rows.select(F.col(a).alias("l")).union(rows.select(F.col(b).alias("l"))).where("l IS NOT NULL").distinct()
    grid = labels.select(F.col("l").alias(a)).crossJoin(labels.select(F.col("l").alias(b)))  # labels by labels, not rows
    return grid.join(rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), [a, b], "left").na.fill(0, ["n"])


def stratified_sample(rows: DataFrame, by: str, fraction: float, seed: int) -> DataFrame:
    """Of each stratum the max(1, round(n * fraction)) rows of least md5 of seed and id; halves round to even."""
    w = Window.partitionBy(by)
    n = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(w) * fraction))
    return rows.withColumn("_r", F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id"))).withColumn("_k", n).where("_r <= _k").drop("_r", "_k")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """items that weren't done yet; entries with an error don't count."""
    return items.join(done.where("error IS NULL").select(*keys).distinct(), keys, "left_anti")


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and base's whose keys new lacks."""
    return new.unionByName(base.join(new.select(*keys).distinct(), keys, "left_anti"))


def batches(items: DataFrame, order: str, size: int) -> DataFrame:
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("category").orderBy(order)) - 1) / size))


def subset(golden: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, known, place) of wanted ids: those of golden (id, number) in its order, numbered from 0; the others are not known and have no place."""
    known = placed(golden.select("id", "number").join(wanted.select("id").distinct(), "id", "left_semi"), [], F.col("number"), F.col("id"))
    unknown = wanted.select("id").distinct().join(golden, "id", "left_anti")
    return known.select("id", F.lit(True).alias("known"), "place").unionByName(unknown.select("id", F.lit(False).alias("known"), F.lit(None).cast("long").alias("place")))


def balanced_subset(items: DataFrame, n: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """The first n by turns of the categories, each in order of number and id."""
    rows = ranked(items.where(~F.col("category").isin(*skip)) if skip else items, ["category"], F.col("number"), F.col("id"), name="_turn")
    return rows.orderBy("_turn", "category").limit(n).drop("_turn")


def config_key(records: DataFrame) -> DataFrame:
    """records with config: rung and condition, and the GPU where there was more than one."""
    w = Window.partitionBy("rung", "condition")
    several = F.size(F.collect_set("gpu").over(w)) > 1
    return records.withColumn("config", F.concat(F.concat_ws("/", "rung", "condition"), F.when(several, F.concat(F.lit("@"), "gpu")).otherwise("")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
