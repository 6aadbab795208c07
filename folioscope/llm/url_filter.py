"""URL filters by pattern rules that are indexed by their rarest literal token (DataFrame functions only).

A rule is `host/path`: it fits its host and all subdomains of it, where the path begins with the rule's; `*` stands for any characters, in
either part, and a rule that begins with `*` may begin anywhere. A literal token is a run of letters and digits that the rule bounds on
both sides, so that every URL that the rule fits holds it as a token too. Each rule is kept under the one of its tokens that is rarest among
all URLs; a URL's tokens fetch the rules under them, and only these are tried as regular expressions. Rules without a literal token
are kept under the empty token, which every URL has. Tokens that many URLs share are dealt to several partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import own_columns, saved, table

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token with this share of the rows and more is dealt to several places, and its rules to each of them.
SHARES = 1000

#: The rules of sites, which come first.
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Rules for URLs that no rule of a site fits: sellers, games of chance, adult pages, trackers, and pages without prose.
PATTERN_RULES = [
    ("*cheap-pills.", "block"), ("*.pills.", "block"), ("*casino*", "block"), ("*-casino.", "block"), ("*.casino.", "block"), ("*.xxx/", "block"), ("*.porn.", "block"), ("*.adult.", "block"),
    ("*.ads.", "block"), ("ads.*", "block"), ("*/wp-login.", "block"), ("*/cart/", "block"), ("*/login/", "block"), ("*/search/", "block"), ("*/tag/", "block"), ("edu/", "allow"), ("gov/", "allow"),
]


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _SMALL)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case, and the path up to `?`, `#` or the end; both are
    empty where url is null or has no `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compiled(rules: DataFrame) -> DataFrame:
    """rules (rule, action, rank) with their regular expression, pattern, for host and path in one string, and their literal tokens.

    A null or empty rule fits nothing and is left out; of repeated rules each stays.
    """
    rule = F.concat(_lower(F.regexp_extract("rule", r"^[^/]*", 0)), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1))
    pieces = F.transform(F.split("rule", r"\*"), lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    start = F.when(F.startswith("rule", F.lit("*")), F.lit("(?s)^")).otherwise(F.lit(r"(?s)^(?:[^/]*\.)?"))
    tokens = F.array_distinct(F.regexp_extract_all(_lower(F.col("rule")), F.lit("(?<![a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), 0))
    rows = own_columns(rules, "rule", "action", "rank").where("rule <> ''").withColumn("shown", F.col("rule")).withColumn("rule", rule)
    return rows.select(F.col("shown").alias("rule"), "action", "rank", F.concat(start, F.array_join(pieces, ".*")).alias("pattern"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens"))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (row, host, path) with rule and action of the rule that fits: the highest rank, then the longest, then the last by its text; null
    where none fits. rules: (rule, action, rank).

    rank lets some rules go before others whatever their length. Repeated rows are judged each; null hosts and paths count as empty; without rules nothing fits.
    """
    rules = saved(compiled(rules), "rules")
    subject = F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit("")))
    words = F.array_distinct(F.concat(F.regexp_extract_all(_lower(F.col("subject")), F.lit("[a-z0-9]+"), 0), F.array(F.lit(""))))
    tokens = urls.select("row", subject.alias("subject")).select("row", "subject", F.explode(words).alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = saved(tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token_counts")
    per_rule = rules.select("rule", "action", "rank", "pattern", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = per_rule.groupBy("rule", "action", "rank", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "token")).alias("kept"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    salts = (F.col("n") * SHARES / F.lit(max(total, 1))).cast("int") + 1
    index = rarest.select("rule", "action", "rank", "pattern", F.col("kept.token").alias("token"), F.col("kept.n").alias("n"))
    index = saved(index.select("rule", "action", "rank", "pattern", "token", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "rule_index")
    large = F.broadcast(counts.select("token", salts.alias("salts")).where("salts > 1"))  # SHARES rows at most
    dealt = tokens.join(large, "token", "left").withColumn("salt", F.coalesce(F.pmod("row", "salts").cast("int"), F.lit(0)))
    found = dealt.join(index, ["token", "salt"]).where(F.regexp_like("subject", F.col("pattern")))
    best = found.groupBy("row").agg(F.max(F.struct("rank", F.char_length("rule").alias("n"), "rule", "action")).alias("best"))
    return urls.join(best, "row", "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"), F.col("best.rank").alias("rank"))


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages (page_id, url) with host, path, rule, action and rank of the rule that fits, and verdict (otherwise where none does).

    A null url, or one without `://`, has an empty host and path. Null and repeated page_ids are rows of their own; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = saved(own_columns(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    return verdicts(rows, rules).withColumn("verdict", F.coalesce("action", F.lit(otherwise))).drop("row")


def rule_table(spark: SparkSession, sites=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    rows = [(r, a, 1) for r, a in sites] + [(r, a, 0) for r, a in patterns]
    return spark.createDataFrame(rows, "rule string, action string, rank int")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "pages"), rule_table(spark))
    return rows.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict")


def _fits(rule: str) -> str:
    """SQL: the rule fits."""
    host, slash, path = rule.partition("/")
    text = host.lower() + slash + path
    start = "" if text.startswith("*") else r"([^/]*\.)?"
    return f"regexp_matches(host || path, '(?s)^{start}{'.*'.join(map(re.escape, text.split('*')))}')"


def _longest(rules: list[tuple[str, str]], column: int) -> str:
    ordered = sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True)
    return "CASE " + " ".join(f"WHEN {_fits(r[0])} THEN '{r[column]}'" for r in ordered) + " END"


ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_SMALL}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_longest(SITE_RULES, 0)} AS rule, coalesce({_longest(SITE_RULES, 1)}, {_longest(PATTERN_RULES, 1)}, 'allow') AS verdict FROM h
"""

QUERIES = {"op12_url_filter": (op12_url_filter, ORACLE)}
