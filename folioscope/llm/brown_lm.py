"""Brown class-based bigram language model.

Words that occur UNIT_COUNT times or more in the training texts are units of their own, however many they are; other words belong to
units by their last two bytes and their length. Units, their classes and their bigrams are tables. The exchange algorithm moves units between classes by the gain in
the class bigrams' likelihood. A word's probability is that of its class after the class before, times that of the word among
its class's words by its own count in the whole training text (absolute discounting; what it frees is shared by as many unseen words as the
class is estimated to have).

Counts of all words stay a distributed table. Texts look up the words that make up 1 / LOOKUP_SHARE of the tokens (LOOKUP_SHARE words at
most) where they are; their other words, none of which is frequent, are joined to the table. Up to SMALL_UNITS units are looked up as
well: then bigrams are numbers, packed into blocks of units that a round of exchange reads without a shuffle. More units
stay a table, and so does all of the exchange: pairs with a unit that isn't looked up are joined to it, for which a bitmap of fixed size is
broadcast that only spares joins. Both ways give the same classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import mapped, mixed, own_columns, saved, scratch, steps, table, text_buffer, words
from folioscope.plans.ship import ship

UNIT_COUNT, LOOKUP_SHARE = 50, 400_000
#: Words of this share of the tokens and more begin in classes by their rank, other units by their hash.
RANKED_SHARE = 10_000
#: Up to this many units are looked up and their classes broadcast (some 40 bytes each); more are joined by a shuffle.
SMALL_UNITS = 2_000_000
#: Tokens whose bigrams a task counts at once, as rows and as packed numbers; tokens for each block of units.
STEP_TOKENS, PACKED_TOKENS, BLOCK_TOKENS = 1 << 20, 1 << 22, 1 << 21
#: Bits of a hash that choose a block of the bitmap, and a bit in its block.
_BLOCK, _BIT = 12, 14
#: Units by word ends, classes (0 is the text's end alone), rounds of exchange, and the weight of class frequencies in transitions.
BUCKETS, CLASSES, EXCHANGES, KAPPA = 256, 64, 6, 20.0
#: A unit is known by its word's hash or its bucket's number; this is a text's end.
END = BUCKETS


def held_out(doc_id, folds: int = 7, fold: int = 2) -> bool:
    """crc32(doc_id as text) mod folds is fold; a null doc_id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def buckets_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bucket of each word: by its last two bytes, A-Z in lower case, and its length."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.int64)
    last, size = low[ends - 1], ends - starts
    second = np.where(size > 1, low[np.maximum(ends - 2, 0)], 0)
    return (last * 31 + second * 131 + np.digitize(size, (2, 3, 5, 7, 10, 14)) * 1009) % BUCKETS


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, last, word hashes, word buckets, bounds) of steps of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    for a, b in steps(offsets):
        starts, ends, hashes, bounds = words(data, offsets[a : b + 1])
        raw = data[int(offsets[a]) : int(offsets[b])]
        yield a, b, hashes.view(np.int64), buckets_of(raw, starts, ends) if len(starts) else starts, bounds


def _chosen(batch: pa.RecordBatch, a: int, b: int, bounds: np.ndarray) -> np.ndarray:
    """Which words are of training texts."""
    train = np.array([not held_out(x) for x in batch.column("doc_id").slice(a, b - a).to_pylist()], bool)
    return np.repeat(train, np.diff(bounds))


def _word_counts(batches):
    for batch in batches:
        hashes, buckets = [], []
        for a, b, h, k, bounds in _texts(batch):
            own = _chosen(batch, a, b, bounds)
            hashes.append(h[own])
            buckets.append(k[own])
        if hashes:
            h, k = np.concatenate(hashes), np.concatenate(buckets)
            unique, at, counts = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(k[at].astype(np.int32)), pa.array(counts.astype(np.int64))], ["word", "bucket", "c"])


@dataclass
class Lookup:
    """Hashes of the words that texts look up, sorted, which of them are units, and a bitmap of the units that aren't among them."""

    words: np.ndarray
    is_unit: np.ndarray
    bits: np.ndarray | None

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the words, whether it is there, whether it may be another unit) of each hash."""
        if not len(self.words):
            none = np.zeros(len(hashes), bool)
            return none.astype(np.int64), none, none if self.bits is None else self._marked(hashes)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        found = self.words[at] == hashes
        return at, found, np.zeros(len(hashes), bool) if self.bits is None else ~found & self._marked(hashes)

    def _marked(self, hashes: np.ndarray) -> np.ndarray:
        spot = hashes.view(np.uint64) >> np.uint64(64 - _BLOCK - _BIT)
        return (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def units(self, hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's unit, and its bucket if the unit is a word that may not be one, else -1."""
        at, found, maybe = self.find(hashes)
        own = found & self.is_unit[at] if len(self.words) else found
        return np.where(own | maybe, hashes, buckets), np.where(maybe, buckets, -1)


def _bit_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << _BIT, bool)
    bits[rows["bit"].to_numpy()] = True
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def bitmap(far: DataFrame) -> np.ndarray:
    """The bitmap of far's words, of 2 ** (_BLOCK + _BIT) bits."""
    ship(far.sparkSession)
    spots = far.select(F.shiftrightunsigned("word", 64 - _BLOCK).alias("block"), F.shiftrightunsigned("word", 64 - _BLOCK - _BIT).bitwiseAND((1 << _BIT) - 1).alias("bit")).distinct()
    size = 1 << (_BIT - 3)
    made = np.zeros(size << _BLOCK, np.uint8)
    for block, bits in spots.groupBy("block").applyInPandas(_bit_blocks, "block long, bits binary").collect():
        made[block * size : (block + 1) * size] = np.frombuffer(bits, np.uint8)
    return made


def _sequence(units: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit before each token, each token's unit, and each text's bounds among the tokens; an end follows each text."""
    n = len(bounds) - 1
    tokens = np.full(len(units) + n, end, np.int64)
    at = np.arange(len(units)) + np.repeat(np.arange(n), np.diff(bounds))
    tokens[at] = units
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    cuts = bounds + np.arange(n + 1)
    before[cuts[:-1]] = end
    return before, tokens, cuts


def _counted(pairs: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
    pair, mark = np.concatenate(pairs, axis=1), np.concatenate(marks, axis=1)
    keys, first, at = np.unique(pair.ravel(), return_index=True, return_inverse=True)
    left, at = mark.ravel()[first].astype(np.int32), at.reshape(2, -1)
    unique, counts = np.unique((at[0] << 32) | at[1], return_counts=True)
    x, y = unique >> 32, unique & 0xFFFFFFFF
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (keys[x], left[x], keys[y], left[y], counts.astype(np.int64))], ["before", "before_bucket", "unit", "unit_bucket", "c"])


def _bigrams(shared):
    def bigrams(batches):
        for batch in batches:
            pairs, marks, held = [], [], 0
            for a, b, h, k, bounds in _texts(batch):
                own, left = shared.value.units(h, k)
                before, tokens, cuts = _sequence(own, bounds, END)
                chosen = _chosen(batch, a, b, cuts)
                pairs.append(np.stack([before[chosen], tokens[chosen]]))
                marks.append(np.stack([x[chosen] for x in _sequence(left, bounds, -1)[:2]]))
                held += len(tokens)
                if held >= STEP_TOKENS:
                    yield _counted(pairs, marks)
                    pairs, marks, held = [], [], 0
            if pairs:
                yield _counted(pairs, marks)

    return bigrams


def unit_bigrams(source: DataFrame, shared, far: DataFrame | None) -> DataFrame:
    """(before, unit, c) of training texts, a bigram in one row or two; units that may be far ones are joined to far (word), others
    go to their buckets. Only bigrams with such a unit are shuffled again."""
    keys = ["before", "before_bucket", "salt", "unit", "unit_bucket"]
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(8))).repartition("before", "salt")  # noqa: E731  rows of a unit in few tasks, so that their sums by class are few
    rows = saved(salted(mapped(source, _bigrams(shared), "before long, before_bucket int, unit long, unit_bucket int, c long")).groupBy(*keys).agg(F.sum("c").alias("c")), "bigrams")
    if far is None:
        return rows.select("before", "unit", "c")
    open_ = rows.where("before_bucket >= 0 OR unit_bucket >= 0")
    for side in ("before", "unit"):
        maybe = F.col(f"{side}_bucket") >= 0
        spread = open_.withColumn("_k", F.when(maybe, F.col(side)).otherwise(F.xxhash64("before", "unit")))  # rows that need no match are dealt out
        open_ = spread.join(far.select(F.col("word").alias("_k"), F.lit(True).alias("_far")), "_k", "left").withColumn(side, F.when(maybe & F.col("_far").isNull(), F.col(f"{side}_bucket").cast("long")).otherwise(F.col(side))).drop("_k", "_far")
    resolved = saved(salted(open_.select("before", "unit", "c")).groupBy("before", "salt", "unit").agg(F.sum("c").alias("c")).drop("salt"), "open-bigrams")
    return rows.where("before_bucket < 0 AND unit_bucket < 0").select("before", "unit", "c").unionByName(resolved)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, now: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Each unit's best class, all others staying: right and left are its counts (unit, class) with classes after and
    before it, own its count with itself, matrix the class bigrams."""
    best = now.copy()
    for i, a in enumerate(now.tolist()):
        s, r, l = own[i], right[i].copy(), left[i].copy()  # noqa: E741
        r[a] -= s
        l[a] -= s
        m = matrix.copy()
        m[a] -= r
        m[:, a] -= l
        m[a, a] -= s
        rows, columns, after, before = m.sum(axis=1) + l, m.sum(axis=0) + r, r.sum() + s, l.sum() + s
        gain = (_xlogx(m + r) - _xlogx(m)).sum(axis=1) + (_xlogx(m + l[:, None]) - _xlogx(m)).sum(axis=0)
        d = np.diagonal(m)
        gain += _xlogx(d + r + l + s) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + l)
        gain -= _xlogx(rows + after) - _xlogx(rows) + _xlogx(columns + before) - _xlogx(columns)
        gain[0] = -np.inf
        c = int(gain.argmax())
        best[i] = c if gain[c] > gain[a] + 1e-9 else a
    return best


def _moved(matrix: np.ndarray):
    def moved(rows: pd.DataFrame) -> pd.DataFrame:
        units, at = np.unique(rows["unit"].to_numpy(), return_inverse=True)
        sides = np.zeros((4, len(units), CLASSES))
        np.add.at(sides, (rows["side"].to_numpy(), at, rows["class"].to_numpy()), rows["c"].to_numpy())
        return pd.DataFrame({"unit": units, "class": best_classes(sides[0], sides[1], sides[2].sum(axis=1), sides[3].argmax(axis=1), matrix)})

    return moved


def likelihood_of(matrix: np.ndarray) -> float:
    return _xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum()


class Rounds:
    """Every round each second unit, by turns, takes its best class. Units that move together may get in each other's way: a round after
    which the class bigrams are less likely is undone, and from then on half as many move at once."""

    def __init__(self):
        self.share, self.kept = 2, None

    def judged(self, classes, matrix: np.ndarray):
        """The classes to go on from, with their class bigrams: those given, or those before them if they are likelier."""
        likelihood = likelihood_of(matrix)
        if self.kept and likelihood < self.kept[0]:
            self.share *= 2
        else:
            self.kept = likelihood, classes, matrix
        return self.kept[1:]


def exchange(bigrams: DataFrame, classes: DataFrame, n_units: int) -> tuple[DataFrame, np.ndarray]:
    """(unit, class) and the class bigrams after EXCHANGES rounds, from bigrams (before, unit, c) and each unit's class at first, for
    more units than can be broadcast: classes stay a table; the driver holds the class bigrams only."""
    ship(bigrams.sparkSession)
    rounds = Rounds()
    for turn in range(EXCHANGES + 1):
        earlier = classes.select(F.col("unit").alias("before"), F.col("class").alias("p"))
        matrix = np.zeros((CLASSES, CLASSES))
        classed = bigrams.join(classes, "unit").groupBy("before", "class").agg(F.sum("c").alias("c"))
        for p, c, n in classed.join(earlier, "before").groupBy("p", "class").agg(F.sum("c")).collect():
            matrix[p, c] = n
        classes, matrix = rounds.judged(classes, matrix)
        if turn == EXCHANGES:
            return classes, matrix
        earlier = classes.select(F.col("unit").alias("before"), F.col("class").alias("p"))
        mine = lambda unit: (F.col(unit) != END) & (F.pmod(F.xxhash64(unit), F.lit(rounds.share)) == turn % rounds.share)  # noqa: B023, E731
        after = bigrams.where(mine("before")).join(classes, "unit").groupBy(F.col("before").alias("unit"), "class").agg(F.sum("c").alias("c")).withColumn("side", F.lit(0))
        before = bigrams.where(mine("unit")).join(earlier, "before").groupBy("unit", F.col("p").alias("class")).agg(F.sum("c").alias("c")).withColumn("side", F.lit(1))
        own = bigrams.where(mine("unit") & (F.col("unit") == F.col("before"))).select("unit", F.lit(0).cast("long").alias("class"), "c", F.lit(2).alias("side"))
        now = classes.where(mine("unit")).select("unit", "class", F.lit(1).cast("long").alias("c"), F.lit(3).alias("side"))
        sides = after.unionByName(before).unionByName(own).unionByName(now)
        parts = F.pmod(F.xxhash64("unit"), F.lit(max(32, n_units // 1000)))
        moved = sides.groupBy(parts.alias("part")).applyInPandas(_moved(matrix), "unit long, class long")
        classes = saved(classes.where(~mine("unit")).unionByName(moved), "classes")


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed with bytes of equal weight together."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _dealt(pairs: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, number of pairs, the pairs' differences, counts) of ascending pairs."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        at = order[x:y]
        yield int(part[at[0]]), y - x, packed(np.diff(pairs[at], prepend=0)), packed(counts[at])


def _summed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of packed rows, ascending, and their counts."""
    pairs = np.concatenate([np.cumsum(unpacked(x, n)) for x, n in zip(rows["pairs"], rows["n"], strict=True)])
    counts = np.concatenate([unpacked(x, n) for x, n in zip(rows["counts"], rows["n"], strict=True)])
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(counts[order], first)


def _packed_bigrams(shared, parts: int):
    """Bigrams of training texts as one number each (unit before << 32 | unit, by their places among the units), dealt by a mix of it."""

    def rows(pairs):
        pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
        made = list(_dealt(pairs, counts, (mixed(pairs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "n", "pairs", "counts"])

    def bigrams(batches):
        lookup, word_places, bucket_places, end = shared.value
        held, n = [], 0
        for batch in batches:
            for a, b, h, k, bounds in _texts(batch):
                at, found, _ = lookup.find(h)
                own = found & lookup.is_unit[at] if len(lookup.words) else found
                places = np.where(own, word_places[at], bucket_places[k]) if len(lookup.words) else bucket_places[k]
                before, tokens, cuts = _sequence(places, bounds, end)
                chosen = _chosen(batch, a, b, cuts)
                held.append(before[chosen] << 32 | tokens[chosen])
                n += len(held[-1])
                if n >= PACKED_TOKENS:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return bigrams


_LOW = (1 << 32) - 1


def _by_unit(blocks: int):
    """A part's pairs once by the unit before and once, turned round, by the unit."""

    def by_unit(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = _summed(rows)
        made = [(*x, 0) for x in _dealt(pairs, counts, (pairs >> 32) % blocks)]
        turned = (pairs & _LOW) << 32 | pairs >> 32
        order = np.argsort(turned)
        made += [(*x, 1) for x in _dealt(turned[order], counts[order], (turned[order] >> 32) % blocks)]
        return pd.DataFrame(made, columns=["block", "n", "pairs", "counts", "side"])

    return by_unit


def _blocked(rows: pd.DataFrame) -> pd.DataFrame:
    made = {"block": [int(rows["block"].iloc[0])]}
    for side, name in enumerate(("after", "before")):
        mine = rows[rows["side"] == side]
        pairs, counts = _summed(mine) if len(mine) else (np.zeros(0, np.int64),) * 2
        made |= {f"n_{name}": [len(pairs)], name: [packed(np.diff(pairs, prepend=0))], f"c_{name}": [packed(counts)]}
    return pd.DataFrame(made)


def packed_bigrams(source: DataFrame, shared, blocks: int) -> DataFrame:
    """A row for each block of units (places modulo blocks): its pairs with units after and before. Pairs are summed by a mix of both units
    first, so that a frequent unit's pairs meet in its block as often as it has neighbours, not as often as it occurs."""
    counted = mapped(source, _packed_bigrams(shared, blocks), "part long, n long, pairs binary, counts binary")
    turned = counted.groupBy("part").applyInPandas(_by_unit(blocks), "block long, n long, pairs binary, counts binary, side int")
    made = turned.groupBy("block").applyInPandas(_blocked, "block long, n_after long, after binary, c_after binary, n_before long, before binary, c_before binary")
    return saved(made, "bigrams")


def _sides(batches, *sides):
    """(block, then units, their neighbours and counts for each side) of each row."""
    for batch in batches:
        for row in batch.to_pylist():
            found = [row["block"]]
            for side in sides:
                pairs = np.cumsum(unpacked(row[side], row[f"n_{side}"]))
                found += [pairs >> 32, pairs & _LOW, unpacked(row[f"c_{side}"], row[f"n_{side}"])]
            yield found


def _class_bigrams(shared):
    def class_bigrams(batches):
        classes, matrix = shared.value, np.zeros(CLASSES * CLASSES)
        for _, units, after, c in _sides(batches, "after"):
            matrix += np.bincount(classes[units].astype(np.int64) * CLASSES + classes[after], weights=c, minlength=len(matrix))
        at = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(matrix[at].astype(np.int64))], ["at", "c"])

    return class_bigrams


def _block_moves(shared, mixes, matrix: np.ndarray, blocks: int, share: int, turn: int):
    def moves(batches):
        classes = shared.value
        for block, *rest in _sides(batches, "after", "before"):
            places = np.arange(block, len(classes), blocks)
            sides = [np.bincount((u - block) // blocks * CLASSES + classes[v], weights=c, minlength=len(places) * CLASSES).reshape(-1, CLASSES) for u, v, c in (rest[:3], rest[3:])]
            own = np.bincount(((rest[0] - block) // blocks)[rest[0] == rest[1]], weights=rest[2][rest[0] == rest[1]], minlength=len(places))
            mine = np.flatnonzero(mixes.value[places] % share == turn % share)
            now = classes[places[mine]].astype(np.int64)
            best = best_classes(sides[0][mine], sides[1][mine], own[mine], now, matrix)
            yield pa.RecordBatch.from_arrays([pa.array(places[mine][best != now]), pa.array(best[best != now])], ["place", "class"])

    return moves


def packed_exchange(blocks_of_units: DataFrame, units: pd.DataFrame, blocks: int) -> tuple[DataFrame, np.ndarray]:
    """As exchange(), for units (unit, class, mix; ascending) that can be broadcast: no round shuffles more than class bigrams."""
    spark, rounds = blocks_of_units.sparkSession, Rounds()
    classes, mixes = units["class"].to_numpy(np.int8), spark.sparkContext.broadcast(units["mix"].to_numpy(np.int64))
    end = int(np.searchsorted(units["unit"].to_numpy(np.int64), END))
    for turn in range(EXCHANGES + 1):
        shared, matrix = spark.sparkContext.broadcast(classes), np.zeros((CLASSES, CLASSES))
        counted = mapped(blocks_of_units.select("block", "n_after", "after", "c_after"), _class_bigrams(shared), "at long, c long")
        for at, n in counted.groupBy("at").agg(F.sum("c")).collect():
            matrix[divmod(at, CLASSES)] = n
        classes, matrix = rounds.judged(classes, matrix)
        if turn == EXCHANGES:
            named = pa.table({"unit": units["unit"].to_numpy(np.int64), "class": classes.astype(np.int64)})
            return spark.createDataFrame(named), matrix
        shared = spark.sparkContext.broadcast(classes)
        moves = mapped(blocks_of_units, _block_moves(shared, mixes, matrix, blocks, rounds.share, turn), "place long, class long").toArrow().to_pandas()
        classes = classes.copy()
        places = moves["place"].to_numpy(np.int64)
        classes[places[places != end]] = moves["class"].to_numpy(np.int8)[places != end]


@dataclass
class Model:
    """What texts are scored by where they are: transitions (class, class), each class's unseen word, both as log10, the classes
    of looked-up words and of buckets, what looked-up words add to an unseen word's scores, and the constants of the base."""

    lookup: Lookup
    classes: np.ndarray
    buckets: np.ndarray
    transitions: np.ndarray
    unseen: np.ndarray
    adds: np.ndarray
    adds_base: np.ndarray
    base_floor: float
    base_end: float
    end_known: int


def _scored(shared):
    def scored(batches):
        m, task, row = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, h, k, bounds in _texts(batch):
                at, found, maybe = m.lookup.find(h)
                own = np.where(found, m.classes[at], m.buckets[k]) if len(m.classes) else m.buckets[k]
                p, c, cuts = _sequence(own, bounds, 0)
                x_far, y_far, _ = _sequence(maybe.astype(np.int64), bounds, 0)
                x_word, y_word, _ = _sequence(h, bounds, 0)
                later = (x_far | y_far) > 0
                per_token = np.where(later, 0.0, m.transitions[p, c] + m.unseen[c])
                score = np.add.reduceat(per_token, cuts[:-1])
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (np.where(found, m.adds[at], 0.0), np.where(found, m.adds_base[at], 0.0), found.astype(np.int64))] if len(m.adds) else [np.zeros(len(h) + 1)] * 3
                for i in range(a, b):
                    x, y = int(bounds[i - a]), int(bounds[i - a + 1])
                    rare, times = np.unique(h[x:y][~found[x:y]], return_counts=True)
                    adds = [s[y] - s[x] for s in sums]
                    u, v = int(cuts[i - a]), int(cuts[i - a + 1])
                    open_ = u + np.flatnonzero(later[u:v])
                    pairs = [x_word[open_], np.where(x_far[open_] > 0, -1 - p[open_], p[open_]).astype(np.int32), y_word[open_], np.where(y_far[open_] > 0, -1 - c[open_], c[open_]).astype(np.int32)]
                    yield_rows.append((task << 33 | row, ids[i], held_out(ids[i]), y - x + 1, int(adds[2]) + m.end_known, (y - x) * m.base_floor + adds[1] + m.base_end, float(score[i - a] + adds[0]), rare, times.astype(np.int32), *pairs))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*yield_rows, strict=True), _KINDS, strict=True)], _NAMES)
                yield_rows.clear()

    yield_rows: list = []
    return scored


_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64()), pa.list_(pa.int32())] * 3]
#: Pairs that wait for a join: each word, and its class, or -1 less the class that it has if it isn't a unit.
_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times", "x_word", "x", "y_word", "y"]
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>, x_word array<long>, x array<int>, y_word array<long>, y array<int>"


def _waiting(texts: DataFrame, far: DataFrame, steps_: np.ndarray) -> DataFrame:
    """(row, s): what the pairs that wait add to a text's score; far: word, class."""
    rows = texts.select("row", F.explode(F.arrays_zip("x_word", "x", "y_word", "y")).alias("z")).select("row", "z.*").groupBy("row", "x_word", "x", "y_word", "y").agg(F.count(F.lit(1)).alias("n"))
    for side in ("x", "y"):
        maybe = F.col(side) < 0
        spread = rows.withColumn("_k", F.when(maybe, F.col(f"{side}_word")).otherwise(F.xxhash64("row", "x_word", "y_word")))  # rows that need no match are dealt out
        rows = spread.join(far.select(F.col("word").alias("_k"), F.col("class").alias("_c")), "_k", "left").withColumn(side, F.when(maybe, F.coalesce("_c", -1 - F.col(side))).otherwise(F.col(side)).cast("long")).drop("_k", "_c")
    n = np.arange(CLASSES * CLASSES)
    named = texts.sparkSession.createDataFrame(pd.DataFrame({"x": n // CLASSES, "y": n % CLASSES, "s": steps_.ravel()}))
    return rows.join(F.broadcast(named), ["x", "y"]).groupBy("row").agg(F.sum(F.col("n") * F.col("s")).alias("w"))


def class_lm(docs: DataFrame) -> DataFrame:
    """scored_by_classes() without the classes."""
    return scored_by_classes(docs)[0]


def unseen_words(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """How many words a class is estimated to have that weren't seen, from those seen once and twice (Chao's bound); one at least."""
    return np.maximum(1.0, np.where(twice > 0, once * once / (2 * np.maximum(twice, 1)), once * (once - 1) / 2))


def scored_by_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10); and the classes (unit, class) of units.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, then one end; a null text is empty and has the end alone.
    Texts that aren't held out are learned from, repeated rows as often as they occur. An empty table gives no rows; if
    every text is held out, all words are unseen. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = own_columns(docs, "doc_id", "text")
    train = source.where(F.col("doc_id").isNull() | (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2))
    counted = mapped(source, _word_counts, "word long, bucket int, c long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c"))
    counts = saved(counted, "word-counts")
    ends = train.count()
    total, distinct, once, twice = counts.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    tokens, distinct = (total or 0) + ends, distinct + bool(ends)
    discount = once / (once + 2 * twice) if once and twice else 0.5

    looked_up, unit = F.col("c") * LOOKUP_SHARE >= tokens, F.col("c") >= UNIT_COUNT
    few = counts.where(unit).count() <= SMALL_UNITS
    if few:
        looked_up = looked_up | unit
    common = counts.where(looked_up).toArrow().to_pandas().sort_values("word")  # LOOKUP_SHARE + SMALL_UNITS rows at most
    far = saved(counts.where(unit & ~looked_up).select("word"), "far-units") if not few and UNIT_COUNT * LOOKUP_SHARE < tokens else None
    lookup = Lookup(common["word"].to_numpy(np.int64), common["c"].to_numpy() >= UNIT_COUNT, None if far is None else bitmap(far))

    # at first, by rank the buckets and the words of RANKED_SHARE (RANKED_SHARE at most); counts and words of each bucket
    in_bucket, types_in, once_in, twice_in = np.zeros((4, BUCKETS))
    for k, *found in counts.where(~unit).groupBy("bucket").agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect():
        in_bucket[k], types_in[k], once_in[k], twice_in[k] = found
    top = common[(common["c"] >= UNIT_COUNT) & (common["c"] * RANKED_SHARE >= tokens)]
    ranks = pd.DataFrame({"unit": np.concatenate([np.arange(BUCKETS), top["word"].to_numpy(np.int64)]), "c": np.concatenate([in_bucket, top["c"].to_numpy(float)])})
    ranks = ranks.sort_values("c", ascending=False, kind="stable")[["unit"]].assign(**{"class": 1 + np.arange(len(ranks)) % (CLASSES - 1)})
    ranks = pd.concat([ranks, pd.DataFrame({"unit": [END], "class": [0]})])
    hashed = counts.where(unit & (F.col("c") * RANKED_SHARE < tokens)).select(F.col("word").alias("unit"), (1 + F.pmod(F.xxhash64("word"), F.lit(CLASSES - 1))).cast("long").alias("class"))
    classes = saved(spark.createDataFrame(ranks, "unit long, class long").unionByName(hashed), "classes")
    with scratch(spark):  # bigrams and the rounds' classes go when the last classes are written
        if few:
            units = classes.withColumn("mix", F.xxhash64("unit")).toArrow().to_pandas().sort_values("unit")
            places = lambda keys: np.searchsorted(units["unit"].to_numpy(np.int64), keys)
            blocks = max(spark.sparkContext.defaultParallelism, tokens // BLOCK_TOKENS)
            shared = spark.sparkContext.broadcast((lookup, places(lookup.words), places(np.arange(BUCKETS)), int(places(END))))
            classes, matrix = packed_exchange(packed_bigrams(source, shared, blocks), units, blocks)
        else:
            classes, matrix = exchange(unit_bigrams(source, spark.sparkContext.broadcast(lookup), far), classes, classes.count())
        classes = saved(classes, "unit-classes", beyond=True)

    # tokens and distinct words of each class; rare words are counted by bucket
    bucket_class = np.zeros(BUCKETS, np.int64)
    for k, c in classes.where((F.col("unit") >= 0) & (F.col("unit") < BUCKETS)).collect():
        bucket_class[k] = c
    sizes, types, once_of, twice_of = (np.bincount(bucket_class, x, CLASSES) for x in (in_bucket, types_in, once_in, twice_in))
    of_words = counts.where(unit).join(classes, F.col("word") == F.col("unit"))
    for k, n, m in of_words.groupBy("class").agg(F.sum("c"), F.count(F.lit(1))).collect():
        sizes[k] += n
        types[k] += m
    sizes[0] = ends
    share = (sizes + 0.5) / (sizes.sum() + 0.5 * CLASSES)
    spread = np.log10(unseen_words(once_of, twice_of))
    with np.errstate(divide="ignore", invalid="ignore"):
        transitions = np.log10((matrix + KAPPA * share) / (matrix.sum(axis=1, keepdims=True) + KAPPA))
        unseen = np.where(sizes > 0, np.log10(discount * types / sizes), 0.0) - spread  # a class without words has unseen ones only
        seen_less = np.where(types > 0, np.log10(discount * types), 0.0) - spread
    unseen[0] = 0.0
    known = of_words.where(looked_up).select("word", "class").toArrow().to_pandas()  # of the words looked up
    spot = bucket_class[common["bucket"].to_numpy(np.int64)] if len(common) else np.zeros(0, np.int64)
    spot[np.searchsorted(lookup.words, known["word"].to_numpy(np.int64))] = known["class"].to_numpy(np.int64)
    c = common["c"].to_numpy(float)
    base_floor = -float(np.log10(tokens + distinct + 1))
    model = Model(lookup, spot, bucket_class, transitions, unseen, np.log10(c - discount) - seen_less[spot], np.log10(c + 1), base_floor, float(np.log10(ends + 1)) + base_floor, int(ends > 0))
    texts = saved(mapped(source, _scored(spark.sparkContext.broadcast(model)), _SCORED), "scored")

    less = lambda k: F.get(F.array(*[F.lit(float(x)) for x in seen_less]), k)
    of_bucket = F.get(F.array(*map(F.lit, bucket_class.tolist())), F.col("bucket"))
    others = counts.where(~looked_up)
    if far is None:
        others = others.withColumn("class", of_bucket)
    else:
        far = saved(of_words.where(~looked_up).select("word", "class"), "far-classes")
        others = others.join(far, "word", "left").withColumn("class", F.coalesce("class", of_bucket))
    others = others.select("word", F.log10(F.col("c") + 1).alias("adds_base"), (F.log10(F.col("c") - discount) - less(F.col("class").cast("int"))).alias("adds"))
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    more = rare.join(others, "word").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.col("adds_base")).alias("b"), F.sum(F.col("times") * F.col("adds")).alias("s"))
    if far is not None:
        more = more.join(_waiting(texts, far, transitions + unseen), "row", "full_outer").withColumn("s", F.coalesce("s", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)))
    sum_of = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return texts.select(*_NAMES[:7]).join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", sum_of("n_known", "k"), F.lit(tokens).cast("long").alias("train_tokens"), sum_of("base_score", "b"), sum_of("score", "s")
    ), classes


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm(table(spark, sf_dir, "documents"))


QUERIES = {"op5_brown_lm": (op5_brown_lm, None)}
