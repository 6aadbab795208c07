"""Prefix trie, URL rules and filter interactions against brute force, with odd inputs (nulls, empty tables, ties, repeated rows, long texts, clashing columns)."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import filter_audit, prefix_trie, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TALKS = "conv_id long, turn long, role string, text string, depth long, x1 long, part int, n_convs string"


def talks_of(spark, rows):
    """Rows (conv_id, turn, role, text) with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 3, 4, 5, "z") for r in rows], TALKS)


def ordered(rows):
    """Turns of each conversation in the stated order."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    talks = {}
    for c, turn, r, t in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, digest(r or "", t or ""), r or "", t or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h, base = zlib.crc32(str(c).encode()) % 6, talks.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = base[:h] + own[h:]
    return out


def brute_trie(talks):
    members, ends = {}, {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in below)
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children, len(childless), saved, digest))
    return sorted(rows, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def some_talks(seed, n=60):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["hi", "héllo 🙂", "", None, "a" * r.randrange(4)])) for c in range(100, 100 + n) for t in range(r.randrange(1, 7))]
    rows += [(200, t, "user", "hi") for t in range(9)] + [(c, t, "user", "hi") for c in range(201, 215) for t in range(8)]
    rows += [(305, 0, "user", "alone"), (None, 0, "user", "lost"), (-5, None, "bot", "first"), (-5, 0, "bot", "second"), (-5, 0, "bot", "second")]
    rows += [(410, t, "user", f"turn {t}") for t in range(40)] + [(400, t, "user", f"turn {t}") for t in range(40)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [2, 3, 8, 64])
def test_trie_equals_brute_force(spark, monkeypatch, height):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = some_talks(height)
    turns = prefix_trie.saved(prefix_trie.numbered_turns(talks_of(spark, rows).repartition(5)), "turns")
    made = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), height=height)
    assert collected(made, COLUMNS) == brute_trie(rebuilt(ordered(rows)))
    assert dict(made.dtypes)["depth"] == "bigint"


def test_trie_of_conversations_as_they_are(spark):
    rows = some_talks(5, 20)
    assert collected(prefix_trie.conversation_trie(talks_of(spark, rows), 4), COLUMNS) == brute_trie(ordered(rows))


def test_trie_without_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.conversation_trie(talks_of(spark, rows)).count() == 0


def test_one_long_conversation_is_dealt_to_several_ranges(spark):
    rows = [(7, t, "user", "x") for t in range(3000)] + [(8, t, "user", "x") for t in range(2999)]
    turns = prefix_trie.saved(prefix_trie.numbered_turns(talks_of(spark, rows).repartition(3)), "turns")
    assert [r[0] for r in turns.where("conv_id = 7").orderBy("place").select("place").collect()] == list(range(1, 3001))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    made = prefix_trie.prefix_trie(turns.withColumnRenamed("place", "depth"), convs)
    assert made.count() == 3001
    root = made.where("depth = 0").first()
    assert (root["n_leaves"], root["saved_tokens"], root["n_convs"]) == (1, 2999, 2)


URLS = [
    (1, "https://WWW.Example.COM/en/1?x=/fr/"), (2, "http://a.example.com/en/2"), (3, "http://example.com/EN/2"), (4, "http://x.net/es/#a"), (5, "http://notexample.com/en/"),
    (6, None), (7, ""), (8, "example.com/en/"), (9, "http://example.com"), (10, "ftp://b.www.example.com/en/?q"), (11, "http://net/fr/"), (12, "http://u:p@y.net:80/fr/"),
    (13, "http://a.org/cart/1"), (14, "http://cheap-pills.a.org/"), (15, "http://www.casino-x.org/p"), (15, "http://www.casino-x.org/p"), (None, "http://com/"), (17, "x://://com/"), (18, "http://e.com/" + "é/" * 50000),
    (19, "http://comx/"), (20, "http://a.com\nb/en/"), (21, "HTTP://ÀÉ.COM/é?"),
]
#: More rules than those of the query: wildcards inside, no token at all, a literal \E, an equal rule twice, an empty and a null one.
RULES = [
    *[(r, a, 1) for r, a in url_filter.SITE_RULES], *[(r, a, 0) for r, a in url_filter.PATTERN_RULES], ("a.*/ca", "block", 2), ("*", "allow", -1), ("x\\Ey/", "block", 0),
    ("com/", "allow", 1), ("", "block", 9), (None, "block", 9), ("*é*", "block", 3), ("e.com/é/é", "allow", 4),
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(UPPER)
    best = None
    for rule, action, rank in rules:
        if not rule:
            continue
        name, slash, tail = rule.partition("/")
        parts = [re.escape(x) for x in (name.translate(UPPER) + slash + tail).split("*")]
        start = "" if rule.startswith("*") else r"([^/]*\.)?"
        if re.match(start + ".*".join(parts), host + path, re.S):
            best = max(best or (rank, len(rule), rule, action), (rank, len(rule), rule, action))
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARES", 7)
    pages = spark.createDataFrame([(*u, "h", "r", 1) for u in URLS], "page_id long, url string, host string, rule string, row int")
    rules = spark.createDataFrame(RULES, "rule string, action string, rank int")
    made = collected(url_filter.judged(pages, rules), ["page_id", "host", "path", "rule", "verdict"])
    assert made == sorted(((i, *brute_verdict(u, RULES)) for i, u in URLS), key=str)
    for empty in (url_filter.judged(pages.limit(0), rules), url_filter.judged(pages, rules.limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'")):
        assert empty.count() == 0


def test_rules_are_tried_on_urls_that_hold_their_rarest_token_alone(spark):
    rules = url_filter.compiled(spark.createDataFrame([("www.example.com/en/", "allow", 1), ("*cheap-pills.", "block", 0), ("*casino*", "block", 0), ("com/e", "block", 0)], "rule string, action string, rank int"))
    assert {r["rule"]: sorted(r["tokens"]) for r in rules.collect()} == {"www.example.com/en/": ["com", "en", "example", "www"], "*cheap-pills.": ["pills"], "*casino*": [""], "com/e": ["com"]}


def brute_audit(docs, labels):
    rows = []
    for d, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        first = min((x for x, y, _ in docs if (y or "") == t and x is not None), default=None)
        again = first is not None and (d is None or d > first)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), again]
        own = [x for x in labels if x[0] is not None and x[0] == d]
        rows.append((source or "", dict(zip("ABCDE", fails, strict=True)), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in mine)
                out.append([part, "".join(order), step, len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((tuple([*x[:-1], shapley[x[0], x[-1]]]) for x in out), key=str)


def test_filter_audit_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.choice([50, 220, 250]))) for _ in range(12)]
    texts += [" ".join(r.choices(words[:20], k=250)), "A B C " * 100, "$" + texts[0], "x\x0by" * 120, None, "", " ", "one " * 60000, "ÀÉ AB", "\x85".join(words)]
    docs = [(i, r.choice(texts), r.choice(["s", "t", "", None])) for i in range(90)] + [(5, texts[0], "s"), (5, texts[0], "s"), (None, texts[0], "t"), (None, "unseen" * 3, "t")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(60)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, True, 3) for d in docs], "doc_id long, text string, source string, A boolean, row int").repartition(3)
    marks = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality long, toxic long, part string")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert collected(filter_audit.audit(df, marks), columns) == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), marks).count() == 0
    whole = filter_audit.audit(df, marks.limit(0))
    assert whole.count() == 600 * 3
    assert whole.where("good_lost + toxic_lost > 0").count() == 0


def test_id_tables_are_joined_without_a_shuffle(spark):
    rows = spark.range(5000).select(F.col("id").alias("row"), F.lit("p").alias("part"), F.lit(False).alias("good"), F.lit(True).alias("toxic"), (F.col("id") % 2 == 0).alias("A"), (F.col("id") % 3 == 0).alias("B"))
    with filter_audit.scratch(spark):
        tables = filter_audit.id_tables(rows, ["A", "B"], 5000)
        left = tables[""].join(tables["A"].select(F.col("row").alias("_row")).hint("shuffle_hash"), F.col("row") == F.col("_row"), "left_anti")
        left = left.join(tables["B"].select(F.col("row").alias("_row")).hint("shuffle_hash"), F.col("row") == F.col("_row"), "left_semi")
        assert left.count() == 833  # odd multiples of three
        assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("failing_") for t in spark.catalog.listTables())
