"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted are documents with label quality 1 that aren't toxic. The model is fitted on all of them that don't judge, whole texts. Its
counts are tables; discounts, lower orders and back-off weights are joins and aggregations of them.

A token's log probability is a sum of what its n-grams add: that of an unknown word, more if the word is known, the back-off weight of
the word before, more if the bigram is known, the back-off weight of the two words before, and more if the trigram is known. All but the
word's own follows from the trigrams with the same middle word. So fitted trigrams are dealt by their middle word, packed, into shards that are written
once, in buckets, and hold counts; words have shards of their own, which tell the others continuation counts. Trigrams of a heavy middle word are dealt on by their
first word, and its bigrams copied to each of these shards. Blocks of documents send each shard the n-grams that may be in the model (a Bloom
filter of it says so), with the documents that hold them, shards work out what theirs add, and blocks get back a sum for each document. Trigrams stay where they are; only what
documents send is shuffled, and documents come in rounds, whose shuffle files go at the end of each. There are as many shards as the fitted text asks for. The
few frequent n-grams are looked up where the documents are, because they would make up most of what is sent; what is looked up
and the Bloom filter are bounded, and only spare work: what they don't settle is sent.

A word that repeats the two before it is a token of its own that is never learned, however often trusted texts hold one: it has
an unknown word's probability, so that a text of one word over and over is as unlikely as noise.

A document is rejected if its perplexity is above a quantile of its language's trusted documents that the model wasn't fitted on.
Outliers among these are taken as labelled wrongly, and PRIOR documents at the quantile of all languages count with them, so that a
language of few trusted documents is judged by its own and all others' ones, alike at every number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import bucketed, fold_of, mapped, mixed, own_columns, saved, scratch, steps, table, text_buffer, words
from folioscope.plans.ship import ship

#: n-grams of this share of the fitted tokens and more are looked up without a join, so there are FREQUENT of an order at most.
FREQUENT = 4_000_000
#: Shards of the model at least, fitted text of a shard, trigrams that are worked on at once, text of a block of documents in tokens, and bytes of text
#: of a round: GROUP_BYTES, or the fitted text GROUP_TIMES.
SHARDS, SHARD_BYTES, PART, BLOCK_TOKENS, GROUP_BYTES, GROUP_TIMES = 32, 1 << 22, 1 << 19, 1 << 20, 1 << 26, 1
#: Tokens of fitted text that a task counts at once.
FIT_TOKENS = 1 << 19
#: Shards of heavy middle words up to which a row for each is broadcast; more are joined by a shuffle.
WORDS = 500_000
#: Languages, and bytes of their names, up to which a row for each is broadcast.
LANGUAGES, LANGUAGE_BYTES = 100_000, 1 << 23
#: The quantile that is the threshold, and how many documents at all languages' quantile are added to a language's own.
QUANTILE, PRIOR = 0.998, 10
#: Trusted documents whose log perplexity is outside the quartiles by more than FENCE times their distance are outliers.
FENCE = 3
#: Bits of the Bloom filter for each n-gram of the model, and in all at most.
BLOOM_BITS, BLOOM_MOST = 8, 1 << 28
#: Hashes of a text's begin and end, and of a word that repeats the two before it.
_BEGIN, _END, _REPEATED = np.uint64(1), np.uint64(2), np.uint64(3)


def _paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(x * np.uint64(0x9E3779B97F4A7C15) + y)


@dataclass
class Grams:
    """The tokens of some texts, ends included, and of each the two words before, the bigram and the trigram that it ends, all
    as hashes, and its text's number; bounds has the n + 1 places where texts begin."""

    word: np.ndarray
    before: np.ndarray
    two_before: np.ndarray
    bigram: np.ndarray
    trigram: np.ndarray
    text: np.ndarray
    bounds: np.ndarray


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Grams:
    _, _, hashes, at = words(data, offsets, lower=False)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at) + 1)
    bounds = at + np.arange(n + 1)
    word = np.full(len(text), _END, np.uint64)
    word[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))] = hashes
    again = (word[2:] == word[1:-1]) & (word[2:] == word[:-2]) & (text[2:] == text[:-2])
    word[2:][again] = _REPEATED
    before, two_before = np.empty_like(word), np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[:-1]] = _BEGIN
    two_before[1:] = before[:-1]
    two_before[bounds[:-1]] = _BEGIN
    return Grams(word, before, two_before, _paired(before, word), _paired(_paired(two_before, before), word), text, bounds)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up in as few bytes as the largest needs, all first bytes before all second ones, so that they compress well."""
    x = np.ascontiguousarray(x, "<u8")
    return x.view(np.uint8).reshape(-1, 8)[:, : max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)].T.tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel()


#: A row of a shard has n n-grams: places of u, v and w among sorted words, and two numbers of each.
_ROWS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), *[(x, pa.binary()) for x in ("words", "u", "v", "w", "c", "m")], ("counts", pa.list_(pa.int64()))])
_ROW = "shard int, kind int, n long, words binary, u binary, v binary, w binary, c binary, m binary, counts array<long>"
#: Kinds of rows: trigrams with their counts (c); bigrams of heavy middle words with both counts (c, m) where they belong, and copies; words (w) with
#: continuation counts (c) that other shards add to; words with their continuation counts and counts (c, m), in shards of their own.
_TRIGRAMS, _HEAVY, _COPY, _CHANGED, _WORDS = range(5)


def _coded(shard: int, kind: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, m: np.ndarray, counts: list[int] | None = None) -> dict:
    words, at = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    u, v, w = np.split(at, np.cumsum([len(u), len(v)]))
    return {"shard": shard, "kind": kind, "n": len(w), "words": words.tobytes()} | {k: _planes(x) for k, x in zip("uvwcm", (u, v, w, c, m), strict=True)} | {"counts": counts}


def _decoded(row: dict) -> tuple[np.ndarray, ...]:
    """u, v, w, c and m; what the row doesn't have is empty."""
    words = np.frombuffer(row["words"], np.uint64)
    get = lambda x: _unplaned(row[x], row["n"] if row[x] else 0)
    return *(words[get(x)] for x in "uvw"), *(get(x).astype(np.int64) for x in "cm")


_NONE = np.zeros(0, np.uint64)


def _joined_rows(rows: pa.Table, *kinds: int) -> tuple[np.ndarray, ...]:
    found = [_decoded(x) for x in rows.filter(pc.is_in(rows["kind"], pa.array(kinds, pa.int32()))).to_pylist()] if len(rows) else []
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (_NONE,) * 3 + (_NONE.astype(np.int64),) * 2


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


@dataclass
class Layout:
    """The shard of n-grams by their middle word; trigrams of a heavy middle word are dealt to several by their first one. Words have shards of their own."""

    shards: int
    homes: int
    heavy: np.ndarray
    salts: np.ndarray

    def place(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        at, heavy = _found(self.heavy, v)
        if heavy.any():
            v = v.copy()
            v[heavy] = _paired(v[heavy], mixed(u[heavy]) % self.salts[at[heavy]])
        return _shard(v, self.shards)

    def places(self, v: int, salts: int) -> list[int]:
        every = _shard(_paired(np.full(salts, v, np.uint64), np.arange(salts, dtype=np.uint64)), self.shards)
        return list(dict.fromkeys(every.tolist()))

    def home(self, w: np.ndarray) -> np.ndarray:
        return self.shards + _shard(w, self.homes)


def _often(share: float):
    """Middle words of this share of a step's tokens and more, with their counts."""

    def often(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in steps(offsets):
                v, counts = np.unique(grams_of(data, offsets[a : b + 1]).before, return_counts=True)
                own = counts >= share * counts.sum()
                yield pa.RecordBatch.from_arrays([pa.array(v[own].view(np.int64)), pa.array(counts[own].astype(np.int64))], ["v", "c"])

    return often


def _counted(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((u, w, v))
    u, v, w, c = (x[order] for x in (u, v, w, c))
    first = _runs(u, v, w)
    return u[first], v[first], w[first], _sums(c, first)


def _dealt(layout: Layout):
    """The trigrams of FIT_TOKENS or so at a time, by shard."""

    def rows(held: list) -> pa.RecordBatch:
        u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        u, v, w, c = _counted(u, v, w, np.ones(len(u), np.int64))
        place = layout.place(u, v)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(layout.shards + 1)).tolist()
        own = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pylist([_coded(k, _TRIGRAMS, u[x], v[x], w[x], c[x], _NONE) for k, x in own], _ROWS)

    def dealt(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in steps(offsets):
                g = grams_of(data, offsets[a : b + 1])
                own = g.word != _REPEATED
                held.append((g.two_before[own], g.before[own], g.word[own]))
                size += int(own.sum())
                if size >= FIT_TOKENS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return dealt


def _bigrams(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """v, w, the number of different words before, and the count, of trigrams in order."""
    first = _runs(v, w)
    return v[first], w[first], np.diff(first, append=len(v)), _sums(c, first)


def _of_counts(c: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, all, and their sum."""
    return [*np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist(), len(c), int(c.sum())]


def _merged(layout: Layout):
    def merged(rows: pa.Table) -> pa.Table:
        u, v, w, c = _counted(*_joined_rows(rows, _TRIGRAMS)[:4])
        bv, _, bc, _ = _bigrams(u, v, w, c)
        light = bc[~_found(layout.heavy, bv)[1]]
        return pa.Table.from_pylist([_coded(rows["shard"][0].as_py(), _TRIGRAMS, u, v, w, c, _NONE, _of_counts(c) + _of_counts(light))], _ROWS)

    return merged


def _heavy_bigrams(layout: Layout):
    def bigrams(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v, w, c, n = _bigrams(*_decoded(row)[:4])
                own = _found(layout.heavy, v)[1]
                yield pa.RecordBatch.from_arrays([pa.array(x[own].view(np.int64)) for x in (v, w, c, n)], ["v", "w", "c", "n"])

    return bigrams


def _copied(rows: pa.Table) -> pa.Table:
    """Plain rows of heavy middle words' bigrams (shard, own, v, w, c, n) as rows of n-grams."""
    out = []
    for own, kind in ((True, _HEAVY), (False, _COPY)):
        x = rows.filter(pc.equal(rows["own"], own))
        if len(x):
            v, w, c, n = (x[k].to_numpy() for k in "vwcn")
            out.append(_coded(x["shard"][0].as_py(), kind, _NONE, v.view(np.uint64), w.view(np.uint64), c, n))
    return pa.Table.from_pylist(out, _ROWS)


def _low(rows: pa.Table, layout: Layout) -> tuple[np.ndarray, ...]:
    """v, w, c, n of all bigrams of a shard's middle words, and whether each is counted there."""
    tri = _joined_rows(rows, _TRIGRAMS)
    v, w, c, n = _bigrams(*tri[:4])
    light = ~_found(layout.heavy, v)[1]
    parts = [(v[light], w[light], c[light], n[light]), _joined_rows(rows, _HEAVY)[1:], _joined_rows(rows, _COPY)[1:]]
    counted = np.repeat([True, True, False], [len(x[0]) for x in parts])
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), counted


def _of_words(w: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    words, at = np.unique(w, return_inverse=True)
    return words, np.bincount(at, weights=c, minlength=len(words)).astype(np.int64), np.bincount(at, weights=n, minlength=len(words)).astype(np.int64)


def _asked(layout: Layout):
    """The words of a shard's bigrams, with their counts there, for the shards of words."""

    def asked(rows: pa.Table) -> pa.Table:
        _, w, _, n, counted = _low(rows, layout)
        words, c, n = _of_words(w, counted, np.where(counted, n, 0))
        home, shard = layout.home(words), rows["shard"][0].as_py()
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], layout.shards + np.arange(layout.homes + 1)).tolist()
        own = [(layout.shards + k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return pa.Table.from_pylist([_coded(k, shard, _NONE, _NONE, words[x], c[x], n[x]) for k, x in own], _ROWS)  # kind: the shard that asks

    return asked


def _answered(rows: pa.Table) -> pa.Table:
    """The words of a shard of words, and for those that ask their words whose continuation count is another one than theirs."""
    found = [(x["kind"], *_decoded(x)[2:]) for x in rows.to_pylist()]
    words, c, n = _of_words(*(np.concatenate(x) for x in list(zip(*found, strict=True))[1:]))
    out = [_coded(rows["shard"][0].as_py(), _WORDS, _NONE, _NONE, words, c, n, _of_counts(c) + [int(n.sum())])]
    for shard, w, own, _ in found:
        total = c[np.searchsorted(words, w)]
        if (other := total != own).any():
            out.append(_coded(shard, _CHANGED, _NONE, _NONE, w[other], total[other], _NONE))
    return pa.Table.from_pylist(out, _ROWS)


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney's discounts of an order of which n counts are 1, 2, 3 and 4: of 0, 1, 2, and 3 or more."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), 0.95 * k) if n[k - 1] else 0.5 * k for k in (1, 2, 3)])


def _shares(context: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram's discounted share of its context and what that leaves to lower orders; the contexts, what each leaves, and each n-gram's place among them."""
    cut = d[np.minimum(c, 3)]
    contexts, at = np.unique(context, return_inverse=True)
    every = np.bincount(at, weights=c)
    rest = np.bincount(at, weights=cut) / every
    return (c - cut) / every[at], rest[at], contexts, rest, at


def _context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The key of two words as a context, which isn't that of the bigram."""
    return mixed(_paired(u, v))


@dataclass
class Fitted:
    """What all shards' addends follow from: the layout, discounts, the sum of continuation counts, the least probability of a word, and all tokens."""

    layout: Layout
    d: list[np.ndarray]
    total: int
    floor: float
    tokens: int

    def _p1(self, c: np.ndarray) -> np.ndarray:
        return (c - self.d[0][np.minimum(c, 3)]) / self.total + self.floor

    def addends(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a shard's rows: sorted keys, what each adds, whether it is frequent, and whether it must be known where documents are. Keys are middle words,
        contexts, bigrams and trigrams, or words; where the context or bigram isn't frequent, it is sent anyway, and the trigram with it."""
        _, _, words, c, n = _joined_rows(rows, _WORDS)
        if len(words):
            return self._sorted([(mixed(words), self._p1(c) / self.floor, n, n > 0)])
        u, middle, last, c = _joined_rows(rows, _TRIGRAMS)[:4]
        v, w, c2, n, counted = _low(rows, self.layout)
        known, c1, _ = _of_words(w, counted, n)
        _, _, changed, total, _ = _joined_rows(rows, _CHANGED)
        c1[np.searchsorted(known, changed)] = total
        share, rest, middles, weights, of = _shares(v, c2, self.d[1])
        lower = rest * self._p1(c1[np.searchsorted(known, w)])
        p2, bigram = share + lower, _paired(v, w)
        order = np.argsort(bigram)
        context = _context(u, middle)
        share, rest, contexts, weights3, of3 = _shares(context, c, self.d[2])
        at = order[np.searchsorted(bigram[order], _paired(middle, last))]
        backed = rest * p2[at]
        seen = lambda at, x, k: np.bincount(at, weights=x, minlength=len(k))
        of_contexts = seen(of3, c, contexts)
        asked = self._often(of_contexts)[of3] & self._often(n)[at]
        return self._sorted([
            (middles, weights, seen(of, n, middles), np.ones(len(middles), bool)), (contexts, weights3, of_contexts, np.ones(len(contexts), bool)),
            (bigram, p2 / lower, n, np.ones(len(bigram), bool)), (_paired(_paired(u, middle), last), (share + backed) / backed, c, asked),
        ])

    def _often(self, n: np.ndarray) -> np.ndarray:
        return n * FREQUENT >= self.tokens

    def _sorted(self, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, adds, n, asked = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        return keys[order], np.log10(adds[order]), self._often(n[order]), asked[order]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of trusted documents, with fold 0 for those that the model isn't fitted on."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("fold", fold_of("doc_id", 5))


def sample(docs: DataFrame, trusted: DataFrame, limit: int | None = None, limit_bytes: int | None = None) -> DataFrame:
    """The texts to learn from: all trusted ones that don't judge. Only where a caller sets a limit of texts or bytes, which classify() doesn't, some of them:
    languages take turns, each in the order of id hashes; a text that no longer fits is passed by."""
    rows = own_columns(docs, "doc_id", "text", "lang").where("text IS NOT NULL").join(trusted.where("fold <> 0").select("doc_id"), "doc_id", "left_semi")
    if limit is None and limit_bytes is None:
        return rows.select("text")
    sizes = rows.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.sum(F.octet_length("text")).alias("size"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = sizes.withColumn("turn", turn).orderBy("turn", F.xxhash64("doc_id"), "doc_id")
    chosen, left = [], limit_bytes
    for doc_id, size in (first if limit is None else first.limit(limit)).select("doc_id", "size").toLocalIterator():
        if left is None or size <= left:
            chosen.append((doc_id,))
            left = None if left is None else left - size
    return saved(rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id").select("text"), "trusted")


@dataclass
class Lookup:
    """What blocks of documents hold of the model, bounded whatever that was fitted on: sorted frequent keys with what they add, a Bloom
    filter of all keys by shard, the layout and number of shards, and the log10 of an unknown word's probability."""

    frequent: np.ndarray
    frequent_adds: np.ndarray
    bloom: np.ndarray
    layout: Layout
    shards: int
    unknown: float

    def may_hold(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for bit in _bits(keys, place, len(self.bloom) * 8 // (self.layout.shards + self.layout.homes)):
            found &= (self.bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        return found


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    return (grams >> np.uint64(40)).astype(np.int64) * shards >> 24


def _bits(keys: np.ndarray, place: np.ndarray | int, each: int) -> list[np.ndarray]:
    """Two bits of a Bloom filter that has each bits for a shard, in the part of the keys' shard."""
    return [place * each + ((keys >> np.uint64(shift)) % np.uint64(each)).astype(np.int64) for shift in (0, 27)]


@dataclass
class Model:
    """The lookup, shards (rows of trigrams, in buckets), more (other rows of the shards), what their addends follow from, and the bytes of the fitted texts."""

    lookup: Lookup
    shards: DataFrame
    more: DataFrame
    fitted: Fitted
    text_bytes: int


def _written(df: DataFrame, name: str, beyond: bool = False, buckets: int = 0) -> DataFrame:
    """saved(), whose shuffle files go as soon as the table is written; with buckets, as a table of so many by shard."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return bucketed(df, name, buckets, "shard", beyond, deal=False) if buckets else saved(df, name, beyond)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _met(more: DataFrame, rows: DataFrame, f, schema: str) -> DataFrame:
    """f of each shard's rows; those in buckets aren't shuffled."""
    return more.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(lambda x, y: f(pa.concat_tables([x, y]) if len(x) and len(y) else x if len(x) else y), schema)


def _looked(fitted: Fitted, each: int):
    def looked(rows: pa.Table) -> pa.Table:
        keys, adds, often, asked = fitted.addends(rows)
        bits = np.zeros(each, bool)
        for bit in _bits(keys[asked], 0, each):
            bits[bit] = True
        found = [x.tobytes() for x in (keys[often], adds[often], np.packbits(bits, bitorder="little"))]
        return pa.table([pa.array([rows["shard"][0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in found]], ["shard", "frequent", "adds", "bloom"])

    return looked


def _totals(rows: DataFrame, width: int) -> list[int]:
    return [x or 0 for x in rows.agg(*[F.sum(F.col("counts")[k]) for k in range(width)]).first()]


def fit(texts: DataFrame) -> Model:
    """The model of texts (text), all of them; without any, every token has the same probability."""
    spark = texts.sparkSession
    ship(spark)
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-text_bytes // SHARD_BYTES))
    often = mapped(texts, _often(PART / max(1, text_bytes)), "v long, c long").groupBy("v").agg(F.sum("c").alias("c"))
    heavy = sorted((v & (1 << 64) - 1, -(-c // PART)) for v, c in often.where(F.col("c") > PART).collect())  # as many as PART fits into the tokens at most
    layout = Layout(shards, max(SHARDS, shards // 16), np.array([v for v, _ in heavy], np.uint64), np.array([c for _, c in heavy], np.uint64))
    with scratch(spark):
        dealt = mapped(texts, _dealt(layout), _ROW)
        rows = _written(dealt.groupBy("shard").applyInArrow(_merged(layout), _ROW), "trigrams", beyond=True, buckets=shards)
        more, sums = spark.createDataFrame([], _ROW), _totals(rows, 12)
        if heavy:
            places = [(v - (1 << 64) if v >> 63 else v, k, i == 0) for v, c in heavy for i, k in enumerate(layout.places(v, c))]
            bigrams = _written(mapped(rows, _heavy_bigrams(layout), "v long, w long, c long, n long").groupBy("v", "w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "heavy")
            own = bigrams.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)], F.count(F.lit(1))).first()
            sums[6:11] = [x + y for x, y in zip(sums[6:11], own, strict=True)]
            at = spark.createDataFrame(places, "v long, shard int, own boolean")
            copies = bigrams.join(F.broadcast(at) if len(places) <= WORDS else at, "v")
            more = _written(copies.groupBy("shard").applyInArrow(_copied, _ROW), "copies", beyond=True)
        words = _written(_met(more, rows, _asked(layout), _ROW).groupBy("shard").applyInArrow(_answered, _ROW), "words", beyond=True)
        *n1, n_words, total, tokens = _totals(words.where(F.col("kind") == _WORDS), 7)
        d = [discounts(x) for x in (n1, sums[6:10], sums[:4])]
        freed = d[0][1] * n1[0] + d[0][2] * n1[1] + d[0][3] * (n_words - n1[0] - n1[1])
        fitted = Fitted(layout, d, total, freed / total / (n_words + 1) if n_words else 1.0, tokens)
        more, parts = more.unionByName(words), shards + layout.homes
        each = 8 * -(-min(max(1 << 16, 2 * (n_words + sums[10]) * BLOOM_BITS), BLOOM_MOST) // (8 * parts))
        made = _written(_met(more, rows, _looked(fitted, each), "shard int, frequent binary, adds binary, bloom binary"), "lookup")
        bloom, frequent = np.zeros(parts * each // 8, np.uint8), [(_NONE, np.zeros(0))]
        for k, x, y, bits in made.toLocalIterator():
            frequent.append((np.frombuffer(x, np.uint64), np.frombuffer(y)))
            bloom[k * len(bits) : (k + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    keys, adds = (np.concatenate(x) for x in zip(*frequent, strict=True))
    keys, first = np.unique(keys, return_index=True)
    return Model(Lookup(keys, adds[first], bloom, layout, shards, float(np.log10(fitted.floor))), rows, more, fitted, text_bytes)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each wanted key's place among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class _Block:
    """n-grams of some documents that wait for the join."""

    def __init__(self, number: int, layout: Layout):
        self.layout = layout
        self.number, self.docs, self.tokens, self.grams, self.words = number, 0, 0, [], []

    def sent(self) -> Iterator[dict]:
        """A row for each shard: distinct n-grams, or words, of each document, and how often it has them."""
        u, v, w, docs = (np.concatenate(x) for x in zip(*self.grams, strict=True))
        yield from self._rows(u, v, w, docs, self.layout.place(u, v))
        w, docs = (np.concatenate(x) for x in zip(*self.words, strict=True))
        yield from self._rows(_NONE, _NONE, w, docs, self.layout.home(w))

    def _rows(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, docs: np.ndarray, place: np.ndarray) -> Iterator[dict]:
        order = np.lexsort((*(x for x in (u, w, v) if len(x)), docs, place))
        place, docs, w = place[order], docs[order], w[order]
        u, v = (x[order] if len(x) else x for x in (u, v))
        first = _runs(*(x for x in (place, docs, w, u, v) if len(x))) if len(w) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(w))
        place, docs, w = place[first], docs[first], w[first]
        u, v = (x[first] if len(x) else x for x in (u, v))
        cuts = _runs(place) if len(w) else first
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(w)], strict=False):
            yield {"block": self.number} | _coded(int(place[a]), 0, u[a:b], v[a:b], w[a:b], docs[a:b], times[a:b])


#: Bytes of text that are cut into n-grams at once where documents are sent: a step's arrays are some fifty times that.
SENT_BYTES = 1 << 18

#: Rows of n-grams are as those of the model, with documents (c) and times (m); rows of documents have the last five columns, and a shard that only carries them.
_KINDS = pa.schema([("block", pa.int64()), *[x for x in _ROWS if x.name != "counts"], ("first", pa.int32()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("lengths", pa.binary()), ("sums", pa.binary())])
_SUMS = "first int, ids array<long>, langs array<string>, lengths binary, sums binary"
_SENT = f"block long, {_ROW.rsplit(',', 1)[0]}, {_SUMS}"


def _sent(shared):
    def sent(batches):
        m: Lookup = shared.value
        task, number = TaskContext.get().partitionId(), 0
        block = _Block(task << 32, m.layout)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in steps(offsets, SENT_BYTES):
                g = grams_of(data, offsets[a : b + 1])
                per_token, docs = np.full(len(g.word), m.unknown), (g.text + block.docs).astype(np.int64)
                place = m.layout.place(g.two_before, g.before)

                def waits(keys, place, tokens, per_token=per_token):
                    maybe = tokens[m.may_hold(keys[tokens], place[tokens])]
                    at, known = _found(m.frequent, keys[maybe])
                    per_token[maybe[known]] += m.frequent_adds[at[known]]
                    return maybe[~known], maybe[known]

                every, wait, often = np.arange(len(g.word)), np.zeros(len(g.word), bool), np.zeros(len(g.word), np.int8)
                for keys in (g.before, _context(g.two_before, g.before), g.bigram):
                    unsure, known = waits(keys, place, every)
                    wait[unsure] = True
                    often[known] += 1
                wait[waits(g.trigram, place, np.flatnonzero(often == 3))[0]] = True  # no other is frequent, and others in the model are sent
                block.grams.append((g.two_before[wait], g.before[wait], g.word[wait], docs[wait]))
                own = waits(mixed(g.word), m.layout.home(g.word), every)[0]
                block.words.append((g.word[own], docs[own]))
                sums = np.add.reduceat(per_token, g.bounds[:-1])
                own = {"block": block.number, "shard": block.number % m.shards, "first": block.docs, "ids": batch.column("doc_id").slice(a, b - a).to_pylist(), "langs": batch.column("lang").slice(a, b - a).to_pylist(), "lengths": np.diff(g.bounds).astype(np.int64).tobytes(), "sums": sums.tobytes()}
                yield pa.RecordBatch.from_pylist([own], _KINDS)
                block.docs, block.tokens = block.docs + b - a, block.tokens + len(g.word)
                if block.tokens >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist(list(block.sent()), _KINDS)
                    number += 1
                    block = _Block(task << 32 | number, m.layout)
        if block.docs:
            yield pa.RecordBatch.from_pylist(list(block.sent()), _KINDS)

    return sent


def _joined(fitted: Fitted):
    def joined(sent: pa.Table, model: pa.Table) -> pa.Table:
        """One sum for each document of each block that has n-grams of the shard; rows of documents as they are. What is frequent was added before."""
        names = [x for x in _ROWS.names if x != "counts"]
        waiting, blocks, sums = sent.filter(pc.and_(pc.is_valid(sent["words"]), pc.is_valid(sent["block"]))), [], []
        of_model = [x.select(names) for x in (sent.filter(pc.is_null(sent["block"])), model) if len(x)]
        keys, adds, often, _ = fitted.addends(pa.concat_tables(of_model)) if of_model and len(waiting) else (_NONE, np.zeros(0), np.zeros(0, bool), None)
        adds[often] = 0.0
        for row in waiting.select([*names, "block"]).to_pylist():
            u, v, w, docs, times = _decoded(row)
            each = np.zeros(len(w))
            for wanted in (v, _context(u, v), _paired(v, w), _paired(_paired(u, v), w)) if row["shard"] < fitted.layout.shards else (mixed(w),):
                at, known = _found(keys, wanted)
                each[known] += adds[at[known]]
            blocks.append(row["block"])
            sums.append(np.bincount(docs, weights=each * times).tobytes())
        of_docs = sent.filter(pc.is_valid(sent["ids"])).select(["block", "first", "ids", "langs", "lengths", "sums"])
        empty = [pa.nulls(len(blocks), of_docs.schema.field(x).type) for x in ("first", "ids", "langs", "lengths")]
        return pa.concat_tables([of_docs, pa.Table.from_arrays([pa.array(blocks, pa.int64()), *empty, pa.array(sums, of_docs.schema.field("sums").type)], schema=of_docs.schema)])

    return joined


def _summed(rows: pa.Table) -> pa.Table:
    more = [np.frombuffer(x.as_py()) for x in rows.filter(pc.is_null(rows["ids"]))["sums"]]
    total = np.zeros(max(map(len, more), default=0))
    for x in more:
        total[: len(x)] += x
    out = []
    of_docs = rows.filter(pc.is_valid(rows["ids"]))
    for first, ids, langs, n, sums in zip(*(of_docs[x] for x in ("first", "ids", "langs", "lengths", "sums")), strict=True):
        own, extra = np.frombuffer(sums.as_py()).copy(), total[first.as_py() : first.as_py() + len(ids)]
        own[: len(extra)] += extra
        out.append(pa.Table.from_arrays([ids.values, langs.values.cast(pa.string()), pa.array(np.frombuffer(n.as_py(), np.int64)), pa.array(own)], ["doc_id", "lang", "n_tokens", "log10_p"]))
    return pa.concat_tables(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, lang, n_tokens and log10_p, the log10 of the text's probability, its end's included."""
    spark = docs.sparkSession
    ship(spark)
    lookup = spark.sparkContext.broadcast(model.lookup)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = int(max(1, -(-size // max(GROUP_BYTES, GROUP_TIMES * model.text_bytes))))
    more, scored = model.more.drop("counts"), []
    for k in range(rounds):
        own = own_columns(docs, "doc_id", "text", "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k) if rounds > 1 else docs
        sent = mapped(own_columns(own, "doc_id", "text", "lang"), _sent(lookup), _SENT).unionByName(more, allowMissingColumns=True)
        sums = sent.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(_joined(model.fitted), f"block long, {_SUMS}")
        scored.append(_written(sums.groupBy("block").applyInArrow(_summed, "doc_id long, lang string, n_tokens long, log10_p double"), "scores"))
    lookup.destroy()
    return reduce(DataFrame.unionByName, scored)


def _by_language(groups: DataFrame, name: str) -> DataFrame:
    """A row for each language (l), written, and broadcast if these are LANGUAGES and LANGUAGE_BYTES of names at most: a language may hold most
    rows, which would meet in one task."""
    written = saved(groups, name)
    n, size = written.agg(F.count(F.lit(1)), F.sum(F.octet_length("l"))).first()
    return F.broadcast(written) if n <= LANGUAGES and (size or 0) <= LANGUAGE_BYTES else written


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, lang, n_tokens, perplexity, threshold and kept.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` and an end; a text without words has the end alone and is kept, as there is nothing to judge.
    A null lang is a language of its own. Without trusted documents that judge all are kept. Repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    trusted = saved(trusted_ids(labels), "trusted-ids")
    scored = score(docs, fit(sample(docs, trusted)))
    perplexity = F.pow(F.lit(10.0), F.least(-F.col("log10_p") / F.col("n_tokens"), F.lit(300.0)))
    rows = _written(scored.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity")), "perplexities")
    judged = rows.where("n_tokens > 1").join(trusted.where("fold = 0").select("doc_id"), "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("l"), F.log10("perplexity").alias("x"))
    at = lambda k: F.percentile_approx("x", k, 10_000)
    fences = _by_language(judged.groupBy("l").agg((at(0.75) + FENCE * (at(0.75) - at(0.25))).alias("fence")), "fences")
    inside = judged.join(fences, "l").where("x <= fence")
    overall = inside.agg(at(quantile)).first()[0]
    if overall is None:
        return rows.select("doc_id", "lang", "n_tokens", "perplexity", F.lit(float("inf")).alias("threshold"), F.lit(True).alias("kept"))
    own = _by_language(inside.groupBy("l").agg(at(quantile).alias("own"), F.count(F.lit(1)).alias("n")), "quantiles")
    n = F.coalesce("n", F.lit(0))
    threshold = F.pow(F.lit(10.0), (F.coalesce(F.col("own") * n, F.lit(0.0)) + PRIOR * overall) / (n + PRIOR))
    joined = rows.join(own, F.coalesce("lang", F.lit("")) == F.col("l"), "left").select("doc_id", "lang", "n_tokens", "perplexity", threshold.alias("threshold"))
    return joined.withColumn("kept", (F.col("n_tokens") == 1) | (F.col("perplexity") <= F.col("threshold")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that classify() rejects; of a repeated doc_id all rows go with one. A row with a null doc_id stays."""
    gone = classify(docs, labels).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": (op4_quality, None)}
