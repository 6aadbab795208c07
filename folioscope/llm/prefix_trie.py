"""The prefix trie of conversations, with subtree sums by a depth-band rollup.

A prefix's key is its depth and two 64-bit values: the exclusive or of hashes of its turns, each hashed with its place. So a key is a
running fold that may be taken in parts: rows are dealt by ranges of (conversation, place), folded within a range, and only the totals of
conversations that cross a range's end (two for each range at most) are passed on. No conversation, however long, is in one task.

A subtree sum explodes no node to all its ancestors. Depths are cut into bands of `height`; a band's root collects its own band's
nodes, the roots are the nodes of a smaller trie that is rolled up in the same way, and then each root's total goes to its parent, a
last row of the band above, and from there to ancestors in that band alone. A node explodes to `height` rows at most and rounds are as
many as the logarithm of the depth to the base `height`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import joined_to_groups, mapped, own_columns, saved, table

HEIGHT = 8
#: Ids of one piece of a list of members; pieces are hashed one after the other.
PIECE_IDS = 1000
_KEY = ["depth", "x1", "x2"]


def running(rows: DataFrame, order: list[Column], values: list[str], fold, join) -> DataFrame:
    """rows (conv_id, ...) with each of values replaced by its running fold over the conversation in that order.

    fold makes an aggregate of a column, join one value of two. Ranges of rows are folded apart.
    """
    ranged = saved(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "ranged")
    crossing = ranged.groupBy("conv_id", "part").agg(*[fold(v).alias(v) for v in values])
    crossing = crossing.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).where("parts > 1")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(crossing.select("conv_id", "part", *[fold(v).over(earlier).alias(f"_{v}") for v in values]))  # two rows for each range
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = ranged.select(*[c for c in ranged.columns if c not in values], *[fold(v).over(inside).alias(v) for v in values])
    done = done.join(carried, ["conv_id", "part"], "left")
    return done.select(*[c for c in rows.columns if c not in values], *[join(F.col(v), F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, chars) of each turn of conversations (conv_id, turn, role, text): place from 1, two hashes of role and
    text, code points of text.

    Turns are in the order of turn, null first, ties in the order of the SHA-256 of their role and text; repeated rows are turns of their
    own. Null role or text is empty. Rows with a null conv_id belong to no conversation and are left out; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    bits = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("place", F.lit(1).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    placed = running(rows, order, ["place"], F.sum, lambda a, b: a + b)
    return placed.select("conv_id", "place", bits(1).alias("h1"), bits(17).alias("h2"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of c - c % 100 and its own turns after its first h, h = crc32(c) % 6: its turns (conv_id,
    depth, h1, h2, chars), and (conv_id, length) of all, turnless ones too. turns: of numbered_turns(), in a saved table."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    asked = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = sizes.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = asked.join(bases, "base", "left").select("conv_id", "base", "h", "own", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = saved(convs, "conversations")
    total = convs.agg(F.sum("own")).first()[0] or 0
    own = joined_to_groups(turns, convs, ["conv_id"], "own", total).where("place > h")
    first = turns.where("conv_id % 100 = 0 AND place <= 5").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "h1", "h2", "chars")
    lent = convs.where("taken > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("depth")).join(first, ["base", "depth"])
    made = own.withColumn("depth", F.col("taken") + F.col("place") - F.col("h")).select("conv_id", "depth", "h1", "h2", "chars")
    return made.unionByName(lent.select(*made.columns)), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation: conv_id, its key (depth, x1, x2), the key before its last turn (p1, p2) and that turn's chars."""
    keyed = turns.select("conv_id", "depth", F.xxhash64("depth", "h1", "h2").alias("k1"), F.xxhash64("h2", "depth", "h1", F.lit(7)).alias("k2"), "chars")
    zero = F.lit(0).cast("long")
    rows = keyed.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars")))
    done = running(rows.withColumns({"x1": F.col("k1"), "x2": F.col("k2")}), [F.col("depth")], ["x1", "x2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return done.select("conv_id", *_KEY, F.col("x1").bitwiseXOR(F.col("k1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("k2")).alias("p2"), "chars")


def rollup(nodes: DataFrame, paths: DataFrame, sums: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """(depth, x1, x2, *sums): sums of nodes (key, conv_id, *sums) over the subtree of each, itself included.

    conv_id is any conversation that has the node's prefix; paths (conv_id, key) holds all prefixes of these. A group of paths that is
    gathered has height rows at most.
    """
    band = F.floor(F.col("depth") / height).cast("long")
    bands = paths.groupBy("conv_id", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct(*_KEY))).alias("path"))
    totals = [F.sum(s).alias(s) for s in sums]
    if deepest >= height:
        placed = nodes.withColumn("band", band).join(bands, ["conv_id", "band"])
        collected = placed.groupBy(F.col("path")[0].alias("top")).agg(*totals).select("top.*", *sums)
        roots = nodes.where(F.col("depth") % height == 0).drop(*sums).join(collected, _KEY)
        higher = lambda df: df.withColumn("depth", (F.col("depth") / height).cast("long"))
        roots = saved(roots, "roots")
        whole = rollup(higher(roots), higher(paths.where(F.col("depth") % height == 0)), sums, deepest // height, height)
        whole = whole.withColumn("depth", F.col("depth") * height).join(roots.select(*_KEY, "conv_id"), _KEY)
        above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("x1").alias("a1"), F.col("x2").alias("a2"))
        passed = whole.drop("x1", "x2").join(above, ["conv_id", "depth"]).groupBy((F.col("depth") - 1).alias("depth"), F.col("a1").alias("x1"), F.col("a2").alias("x2"))
        passed = passed.agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        nodes = nodes.join(passed, _KEY, "left").select(*_KEY, "conv_id", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])
    within = nodes.withColumn("band", band).join(bands, ["conv_id", "band"])
    inner = F.slice("path", F.lit(1), (F.col("depth") - F.col("band") * height + 1).cast("int"))
    return saved(within.select(F.explode(inner).alias("top"), *sums).groupBy("top").agg(*totals).select("top.*", *sums), "rolled")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which arrive in order; no more than a batch is held."""
    key, state = None, hashlib.sha256()
    schema = pa.schema([(k, pa.int64()) for k in _KEY] + [("ends_sha256", pa.string())])
    made = lambda keys, digests: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(digests, pa.string())], schema=schema)
    for batch in batches:
        keys, digests = [], []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "ids"]), strict=True):
            if now != key:
                if key is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield made(keys, digests)
    if key is not None:
        yield made([key], [state.hexdigest()])


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): lower-case SHA-256 of the ascending, comma-joined conv_ids of each key of ends (key, conv_id).

    Ids are sorted and joined in pieces of PIECE_IDS. The digest of several pieces is sequential by its definition; they are
    hashed as a stream, in which no list is held.
    """
    ranged = saved(ends.repartitionByRange(*_KEY, "conv_id").withColumn("part", F.spark_partition_id()), "ends")
    place = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy("conv_id")) - 1
    pieces = ranged.withColumn("piece", F.floor(place / PIECE_IDS)).groupBy(*_KEY, "part", "piece").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = saved(pieces.select(*_KEY, F.struct("part", "piece").alias("at"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "pieces")
    counts = pieces.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    several = counts.where("n > 1").drop("n")
    whole = pieces.join(several, _KEY, "left_anti").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    streams = pieces.join(several, _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "at").select(*_KEY, "ids")
    return whole.unionByName(mapped(streams, _hashed, "depth long, x1 long, x2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per distinct prefix of the conversations convs (conv_id, length), whose turns are (conv_id, depth, h1, h2, chars): conv_id (the
    smallest of its members), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root (depth 0) has all conversations, turnless ones too. Without a conversation there is no node.
    """
    every = saved(prefixes(turns, convs), "prefixes")
    nodes = every.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = saved(nodes, "nodes")
    total, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    inner = nodes.where("depth > 0")
    children = inner.groupBy(*above).agg(F.count(F.lit(1)).alias("n_children"))
    parents = saved(nodes.select(*_KEY, F.col("conv_id").alias("parent_conv_id")).join(children, _KEY), "parents")
    named = joined_to_groups(inner.select("x1", "x2", F.col("depth").alias("own"), *[c.alias(f"_{n}") for c, n in zip(above, _KEY, strict=True)]), parents.select(*[F.col(k).alias(f"_{k}") for k in _KEY], "parent_conv_id", "n_children"), [f"_{k}" for k in _KEY], "n_children", total)
    named = named.select(F.col("own").alias("depth"), "x1", "x2", "parent_conv_id")
    facts = nodes.join(named, _KEY, "left").join(parents.drop("parent_conv_id"), _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    facts = facts.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars", "p1", "p2")
    facts = saved(facts, "facts")
    sums = ["n_leaves", "saved_tokens"]
    rolled = rollup(facts.select(*_KEY, "conv_id", *sums), every.select("conv_id", *_KEY), sums, deepest or 0, height)
    ends = joined_lengths(every, convs)
    out = facts.drop(*sums).join(rolled, _KEY).join(member_digests(ends), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def joined_lengths(every: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefixes that are whole conversations: key, conv_id. A conversation has one row at its length, so nothing is skewed."""
    return every.select("conv_id", *_KEY).join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*_KEY, "conv_id")


def conversation_trie(conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """prefix_trie() of conversations (conv_id, turn, role, text) as they are; nulls, ties and repeated rows as in numbered_turns()."""
    turns = saved(numbered_turns(conversations), "turns")
    convs = saved(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "conversations")
    return prefix_trie(turns.withColumnRenamed("place", "depth"), convs, height)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(saved(numbered_turns(table(spark, sf_dir, "conversations")), "turns")))


def _crc32_table() -> str:
    """The table of CRC-32 (polynomial 0xEDB88320) as an SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return "[" + ", ".join(map(str, out)) + "]"


ORACLE = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS base,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
      lambda a, b: xor(a >> 8, ({_crc32_table()}::BIGINT[])[(xor(a, b) & 255) + 1]))) % 6 AS h FROM o GROUP BY conv_id
), r AS (
  SELECT s.conv_id, o.place AS part, 0 AS mine, role, text FROM s JOIN o ON o.conv_id = s.base AND o.place <= s.h
  UNION ALL SELECT s.conv_id, o.place, 1, role, text FROM s JOIN o ON o.conv_id = s.conv_id AND o.place > s.h
), d AS (
  SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, length(text) AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY mine, part)
), p AS (SELECT conv_id, depth, md5(path::VARCHAR) AS x, chars FROM d UNION ALL SELECT conv_id, 0, 'root', 0 FROM s),
n AS (SELECT depth, x, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY depth, x),
u AS (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n m ON m.depth = p.depth AND m.x = p.x),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (conv_id, depth)),
t AS (SELECT p.depth, p.x, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * f.chars) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.x),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT p.depth, p.x, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN l USING (conv_id, depth) GROUP BY p.depth, p.x)
SELECT f.conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN t USING (depth, x) LEFT JOIN e USING (depth, x)
"""

QUERIES = {"op11_prefix_trie": (op11_prefix_trie, ORACLE)}
