"""N-gram Jaccard join by forests of signature trees.

Shingle sets are sets of 64-bit hashes of word n-grams. A pair of sizes a <= b that links differs in at most
a * (1 - t) / t shingles, H say, so of K > H segments of the hash range at least K - H hold the same shingles in both. Each
document therefore has K segment keys in every size band in which it can have a partner, and three exact bounds part the
documents into small clusters that hold all links: a document without K - H keys that others share has no partner; of two
partners' H + 1 *strongest* keys (those of most shingles, then of least key) one at least is shared; and links stay within
the connected components of such keys.

Each cluster gets signature trees, over blocks of BLOCK documents at most: documents in order of size and least hash are
leaves, and a node holds the OR of their token bitmaps and the range of their sizes. A bit stands for one token that several of the
sets hold, so that two documents' common bits are their exact overlap and two nodes' are the most that any pair of them can have. Two
trees (or one with itself) are walked together; a pair of nodes is dropped if its sizes can't match, if the common bits are
too few for the overlap that the smallest sizes need, or if all its documents are known to be connected. Clusters of several blocks then compare one document
of each part found, in blocks again, and last all documents outside the cluster's largest part with every block, so that no link between parts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.graph import components
from folioscope.llm.shared import fitted, joined_to_groups, mapped, mixed, own_columns, saved, steps, table, text_buffer, words

#: Documents in a block, in a bottom node, and children of a node.
BLOCK, LEAF, FAN = 256, 8, 8
#: Blocks of documents outside the clusters' largest parts that are compared with all blocks at once; more are first compared in other blocks.
CROSSED = 8
#: Size bands grow by this factor; a band has this many keys for each key that partners may not share.
BAND, SPARE = 1.25, 1.4

_EDGES = [1]
while _EDGES[-1] < 1 << 33:
    _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * BAND)))
_EDGES_ARRAY = np.array(_EDGES)


def differing(band: int, percent: int) -> int:
    """H: the shingles in which partners may differ whose smaller set is in the band."""
    return (_EDGES[band + 1] - 1) * (100 - percent) // percent


def key_count(band: int, percent: int) -> int:
    return int(differing(band, percent) * SPARE) + 1


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than k words has its whole sequence as one shingle."""
    with np.errstate(over="ignore"):
        folded = hashes.copy()
        for j in range(1, k):
            n = max(0, len(hashes) - j)
            folded[:n] = mixed(folded[:n] * np.uint64(31) + hashes[j:])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(folded[a : b - k + 1])
            elif b > a:
                x = hashes[a : a + 1].copy()
                for j in range(a + 1, b):
                    x = mixed(x * np.uint64(31) + hashes[j : j + 1])
                yield mixed(x + np.uint64(b - a))
            else:
                yield hashes[:0]


def segment_keys(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The strong and the other keys of a set, in every band of a possible smaller partner; the low 7 bits are the band."""
    n, strong, other = len(shingles), [], []
    top, low = (int(np.searchsorted(_EDGES_ARRAY, x, "right")) - 1 for x in (n, -(-n * percent // 100)))
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mixed(shingles), out=sums[1:])
        for band in range(low, top + 1):
            k, h = key_count(band, percent), differing(band, percent)
            cuts = np.searchsorted((shingles >> np.uint64(32)) * np.uint64(k) >> np.uint64(32), np.arange(k + 1))
            keys = mixed(sums[cuts[1:]] - sums[cuts[:-1]] + mixed(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)))
            keys = (keys & ~np.uint64(127)) | np.uint64(band)
            order = np.lexsort((keys, -np.diff(cuts)))
            strong.append(keys[order[: h + 1]])
            other.append(keys[order[h + 1 :]])
    return np.concatenate(strong).view(np.int64), np.concatenate(other).view(np.int64)


def _each_set(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = text_buffer(batch.column("text"))
    for a, b in steps(offsets):
        _, _, hashes, bounds = words(data, offsets[a : b + 1])
        yield from shingle_sets(hashes, bounds, k)


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        m = mixed(s)
        return (int(m.sum(dtype=np.uint64)) >> 1), (int(mixed(m + s).sum(dtype=np.uint64)) >> 1)


def _profiles(k: int):
    def profiles(batches):
        for batch in batches:
            rows = [(len(s), *_digest(s)) for s in _each_set(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [])))], ["doc_id", "n_shingles", "d1", "d2"])

    return profiles


def _keys(k: int, percent: int):
    def keys(batches):
        for batch in batches:
            known: set = set()  # copies have the keys of the first one
            strong, other = [], []
            for s in _each_set(batch, k):
                copy = (len(s), *_digest(s)) in known if len(s) else True
                known.add((len(s), *_digest(s)))
                a, b = (s[:0].view(np.int64),) * 2 if copy else segment_keys(s, percent)
                strong.append(a)
                other.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(strong, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], ["doc_id", "strong", "other"])

    return keys


def _sets(k: int):
    def sets(batches):
        for batch in batches:
            made = [s.tobytes() for s in _each_set(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("doc_id"), pa.array([len(s) // 8 for s in made], pa.int64()), pa.array(made, pa.binary())], ["cluster", "doc_id", "n", "shingles"])

    return sets


def bitmaps(groups: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Of each group of sets a row of bits for each set: a bit for every token that two sets of all groups hold. No other
    token can be shared, so that common bits are common tokens."""
    every = [x for g in groups for x in g]
    _, at, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    width = -(-int(shared.sum()) // 64) * 64 or 64
    rows, a = np.zeros((len(every), width // 8), np.uint8), 0
    for row, x in zip(rows, every, strict=True):
        own = at[a : a + len(x)]
        a += len(x)
        bits = np.zeros(width, bool)
        bits[column[own[shared[own]]]] = True
        row[:] = np.packbits(bits)
    return np.split(rows.view(np.uint64), np.cumsum([len(g) for g in groups])[:-1])


class SignatureTree:
    """A tree over sets: level 0 has the documents, level 1 the bottom nodes, the last level the root."""

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray], bits: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.docs = docs[order]
        sizes = np.array([len(sets[i]) for i in order])
        #: by level: token bitmaps, least and largest size; from and to document of each node
        self.levels = [(bits[order], sizes, sizes)]
        self.ranges = [np.stack([np.arange(len(sets)), np.arange(1, len(sets) + 1)], axis=1)]
        while len(self.levels[-1][0]) > 1 or len(self.levels) == 1:
            at = np.arange(0, len(self.levels[-1][0]), LEAF if len(self.levels) == 1 else FAN)
            tokens, low, high = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(tokens, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            inner = self.ranges[-1]
            self.ranges.append(np.stack([inner[at, 0], inner[np.append(at[1:], len(inner)) - 1, 1]], axis=1))

    def children(self, level: int, i: int) -> range:
        fan = FAN if level > 1 else LEAF
        return range(i * fan, min((i + 1) * fan, len(self.ranges[level - 1])))


def walk(a: SignatureTree, b: SignatureTree, percent: int, labels: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between a's and b's documents that join parts; labels (document: its part) is kept up to date."""
    trees = (a,) if a is b else (a, b)
    of = [np.array([labels[d] for d in t.docs.tolist()]) for t in trees]
    members: dict[int, list[int]] = {}
    for d, part in labels.items():
        members.setdefault(part, []).append(d)
    la, lb = of[0], of[-1]

    def join(x: int, y: int) -> None:
        p, q = sorted((labels[x], labels[y]))
        for d in members[q]:
            labels[d] = p
        members[p] += members.pop(q)
        for x in of:
            x[x == q] = p

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        u, i, v, j = stack.pop()
        (a0, a1), (b0, b1) = a.ranges[u][i], b.ranges[v][j]
        if (la[a0:a1] == la[a0]).all() and (lb[b0:b1] == la[a0]).all():
            continue
        (ta, lowa, higha), (tb, lowb, highb) = (x[i] for x in a.levels[u]), (x[j] for x in b.levels[v])
        if 100 * higha < percent * lowb or 100 * highb < percent * lowa:
            continue
        same = a is b and (u, i) == (v, j)
        needed = -(-percent * (int(lowa) + int(lowb)) // (100 + percent))
        if not same and int(np.bitwise_count(ta & tb).sum(dtype=np.int64)) < needed:
            continue
        if u == 1 and v == 1:
            sizes = a.levels[0][1][a0:a1, None] + b.levels[0][1][None, b0:b1]
            common = np.bitwise_count(a.levels[0][0][a0:a1, None] & b.levels[0][0][None, b0:b1]).sum(axis=2, dtype=np.int64)
            for x, y in np.argwhere(100 * common >= percent * (sizes - common)).tolist():
                x, y = x + int(a0), y + int(b0)
                if la[x] != lb[y]:
                    yield int(a.docs[x]), int(b.docs[y])
                    join(int(a.docs[x]), int(b.docs[y]))
        elif same:
            kids = a.children(u, i)
            stack += [(u - 1, x, u - 1, y) for x in kids for y in kids if x < y] + [(u - 1, x, u - 1, x) for x in kids]
        elif u >= v and u > 1:
            stack += [(u - 1, x, v, j) for x in a.children(u, i)]
        else:
            stack += [(u, i, v - 1, y) for y in b.children(v, j)]


def _sets_of(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows["shingles"]]


def _within(percent: int):
    def within(rows: pd.DataFrame) -> pd.DataFrame:
        labels = dict(zip(rows["doc_id"].tolist(), rows["part"].tolist(), strict=True))
        found = []
        if len(rows) > 1:
            sets = _sets_of(rows)
            tree = SignatureTree(rows["doc_id"].to_numpy(), sets, *bitmaps([sets]))
            found = list(walk(tree, tree, percent, labels))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return within


def _between(percent: int):
    def between(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["side"] == k] for k in (0, 1)]
        sets = [_sets_of(x) for x in sides]
        a, b = (SignatureTree(x["doc_id"].to_numpy(), y, z) for x, y, z in zip(sides, sets, bitmaps(sets), strict=True))
        labels = dict(zip(rows["doc_id"].tolist(), rows["part"].tolist(), strict=True))
        return pd.DataFrame(list(walk(a, b, percent, labels)), columns=["a", "b"], dtype="int64")

    return between


def _blocked(items: DataFrame, salt: int) -> DataFrame:
    """items (cluster, doc_id, ...) with a block number, BLOCK items each or so."""
    counts = items.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    sized = joined_to_groups(items, counts, ["cluster"], "_n", items.count())
    numbered = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.ceil(F.col("_n") / BLOCK)).cast("long")).drop("_n")
    return numbered.repartition("cluster", "block")  # not by cluster alone, which would leave a large one in one task


def linked_parts(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect exactly the documents of sets (cluster, doc_id, n, shingles) that links connect in a cluster."""
    size = sets.count()
    few = lambda df: fitted(df, size, 2 * BLOCK)  # noqa: E731  a task for two blocks of documents at least
    within = lambda rows: saved(few(rows.groupBy("cluster", "block").applyInPandas(_within(percent), "a long, b long")), "links")
    known = components(within(_blocked(sets.withColumn("part", F.col("doc_id")), 0)))
    large = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("cluster")
    members = sets.select("cluster", "doc_id").join(large, "cluster", "left_semi")
    units = saved(few(members.join(known, members["doc_id"] == known["node"], "left").select("cluster", "doc_id", F.coalesce("component", "doc_id").alias("part"))), "units")
    salt, before = 0, None
    while True:  # in other blocks, until few documents are left outside each cluster's largest part or rounds gain little
        largest = units.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("top")).select("cluster", F.col("top.part").alias("part"))
        others = units.join(largest, ["cluster", "part"], "left_anti")
        left = others.count()
        if left <= CROSSED * BLOCK or before is not None and 5 * left > 4 * before:
            break
        salt, before = salt + 1, left
        fresh = within(_blocked(sets.join(units, ["cluster", "doc_id"]), salt))
        # only parts are connected from now on, by what a round has found between them
        part_of = lambda side: units.select(F.col("doc_id").alias(side), F.col("part").alias(f"_{side}"))
        merged = components(fresh.join(part_of("a"), "a").join(part_of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        units = saved(few(units.join(merged, units["part"] == merged["node"], "left").select("cluster", "doc_id", F.coalesce("component", "part").alias("part"))), "units")
    parts = units.select(F.col("doc_id").alias("node"), "part")
    edges = known.join(parts, "node", "full_outer").select(F.col("node").alias("a"), F.coalesce("part", "component").alias("b")).where("a <> b")
    if not left:
        return edges
    units = saved(few(_blocked(units, 0)), "units")
    others = saved(few(_blocked(others, salt + 1)), "others")
    pairs = others.select("cluster", F.col("block").alias("x")).distinct().join(units.select("cluster", F.col("block").alias("y")).distinct(), "cluster")
    left_side = pairs.join(others.select("cluster", F.col("block").alias("x"), "doc_id", "part"), ["cluster", "x"]).withColumn("side", F.lit(0))
    right_side = pairs.join(units.select("cluster", F.col("block").alias("y"), "doc_id", "part"), ["cluster", "y"]).withColumn("side", F.lit(1))
    rows = left_side.unionByName(right_side).join(sets, ["cluster", "doc_id"])
    crossed = rows.groupBy("cluster", "x", "y").applyInPandas(_between(percent), "a long, b long")
    return edges.unionByName(saved(crossed, "crossed"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles and component_id.

    A set has the distinct shingles of k words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; with fewer words the whole sequence
    is one. Documents link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links reach,
    the document's own included. A null or empty text, or one without words, has no shingle and no link. Rows that repeat a
    doc_id are linked with each other; a null doc_id takes part in no link and has a null component. An empty table gives
    no rows; other columns are ignored.
    """
    source = own_columns(docs, "doc_id", "text")
    profile = saved(mapped(source, _profiles(k), "doc_id long, n_shingles long, d1 long, d2 long"), "profiles")
    digest = ["n_shingles", "d1", "d2"]
    nodes = profile.where("doc_id IS NOT NULL AND n_shingles > 0")
    copies = nodes.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    # keys that two rows share
    keyed = mapped(source.where("doc_id IS NOT NULL"), _keys(k, percent), "doc_id long, strong array<long>, other array<long>")
    tagged = keyed.select("doc_id", F.explode(F.array(F.struct(F.lit(True).alias("strong"), F.col("strong").alias("keys")), F.struct(F.lit(False).alias("strong"), F.col("other").alias("keys")))).alias("s"))
    rows = tagged.select("doc_id", "s.strong", F.explode("s.keys").alias("key"))
    by_key = Window.partitionBy("key")
    shared = saved(rows.withColumn("c", F.count(F.lit(1)).over(by_key)).where("c > 1").drop("c"), "shared-keys")
    # the same among the first of copies, and documents that share enough keys
    names = saved(joined_to_groups(nodes, copies, digest, "rows", nodes.count()).select("doc_id", "rep").distinct(), "names")
    of_reps = shared.join(names, "doc_id").select("key", "rep", "strong").repartition("key").groupBy("key", "rep").agg(F.max("strong").alias("strong"))
    again = of_reps.withColumn("c", F.count(F.lit(1)).over(by_key)).where("c > 1").withColumn("band", F.col("key").bitwiseAND(127))
    again = saved(again.select("key", "rep", "strong", "band"), "rep-keys")
    need = F.get(F.array(*[F.lit(key_count(b, percent) - differing(b, percent)) for b in range(len(_EDGES) - 1)]), F.col("band").cast("int"))
    able = again.groupBy("rep", "band").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= need).select("rep", "band")
    strong = again.where("strong").join(able, ["rep", "band"], "left_semi")
    stars = saved(strong.withColumn("b", F.min("rep").over(by_key)).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "stars")
    # each document keeps the edge to its least centre, and its other centres get one to that: as connected, and centres are few
    least = stars.groupBy("a").agg(F.min("b").alias("low"))
    of_centres = stars.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    clusters = components(of_centres.unionByName(least.select("a", F.col("low").alias("b"))))
    members = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    sets = saved(mapped(source.join(members, "doc_id").select("cluster", "doc_id", "text"), _sets(k), "cluster long, doc_id long, n long, shingles binary").where("n > 0"), "sets")
    linked = components(linked_parts(sets, percent).unionByName(names.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return profile.join(linked, profile["doc_id"] == linked["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are linked with one of smaller doc_id; a row with a null doc_id stays."""
    gone = jaccard_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')]
    ELSE list_distinct(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) END AS g FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b
)
SELECT s.doc_id, cast(len(g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(g)
"""

QUERIES = {"op1_jaccard_join": (op1_jaccard_join, ORACLE)}
