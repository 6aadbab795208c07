"""Best-fit packing by bin completion with branch and bound.

Documents become token ids in the executors and are cut into pieces of one sequence at most. How many pieces there are of each
length is all that packing depends on, and that is a table of as many rows as a sequence has tokens, whatever the size of
the corpus. The search over it completes the bin of the largest piece left with undominated fillings, all of them, in the order of their
waste; applies a filling as often as the counts allow, then, on its way back, less often; prunes a branch whose waste
exceeds what a better packing could have; and keeps the best packing so far, first that of best fit, as incumbent. It ends
when the incumbent is as small as the lower bound or nothing is left to try, which both prove it optimal, or after a stated number of steps.
Pieces get their place by a distributed rank among those of their length and a join with the packing's rank ranges.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.shared import STEP_BYTES, mapped, own_columns, saved, steps, table, text_buffer

CAPACITY = 2048
#: Steps of the search at most: nodes, and lengths tried in fillings. Only a search that spends them all may miss the best packing, and says so.
STEPS = 2_000_000
#: Bytes that the words which a Python worker remembers take, or about, besides as many of older ones; when they are more it forgets the older ones.
REMEMBERED = 48 << 20

Filling = tuple[int, ...]

#: Letters of which a word is one token word each, whatever stands beside it; signs that may end such a word.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_SIGNS = b".,;:!?"
#: Words that are encoded as one text.
_JOINED = 2000


class WordIds:
    """The ids of white-space parted words, as little-endian 32-bit integers, remembered up to REMEMBERED bytes and as many older ones.

    The tokenizer ends each run of letters with a token of its own kind, so that many words of letters are encoded as one text
    and cut there; signs behind an ASCII letter or digit are a run by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True

    def learn(self, wanted: set[bytes]) -> None:
        if self.size > REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        wanted = wanted - known.keys()
        missing = set(wanted)
        for word in missing & older.keys():
            known[word] = older[word]
        missing -= older.keys()
        parted = []
        for word in missing:
            if word[-1] in _SIGNS:
                core = word.rstrip(_SIGNS)
                if core[-1:].isalnum():
                    parted.append((word, core, word[len(core) :]))
        missing.difference_update([x[0] for x in parted])
        missing.update([x[1] for x in parted], [x[2] for x in parted])
        missing -= known.keys()
        letters = [x for x in missing if x.isalpha() or _LETTERS.fullmatch(x.decode())]
        others = list(missing.difference(letters))
        made = self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False)
        known.update(zip(others, [np.array(x.ids, "<u4").tobytes() for x in made], strict=True))
        for a in range(0, len(letters), _JOINED):
            part = letters[a : a + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            known.update(zip(part, [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        for word, core, tail in parted:
            known[word] = known[core] + known[tail]
        self.size += sum(3 * len(x) + 150 for x in wanted)  # the word, its ids, and the table's own share


_WORD_IDS: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def split_words(text: bytes) -> list[bytes]:
    """A text's words; in lower case, as the tokenizer would have them, where none can be a special token."""
    return (text if b"<|" in text else text.lower()).split()


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """White space always parts this tokenizer's words, so a text's ids are those of its words one after the other."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _word_ids(path), end_id.to_bytes(4, "little")
        task, counts = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, 4 * STEP_BYTES):
                texts = [split_words(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(a, b)]
                words.learn(set().union(*texts))
                known = words.known
                out = []
                for k, text in zip(range(a, b), texts, strict=True):
                    ids = b"".join([known[x] for x in text]) + end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        length = len(own) // 4
                        out.append((doc_ids[k], piece, start, length, zlib.crc32(own), task, counts[length], own if with_ids else None))
                        counts[length] += 1
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], _NAMES)
        words.older.clear()

    return pieces


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text), saved; task and nth number a task's pieces of one length.

    A null text is empty and has the end id alone; repeated rows are packed again; an empty table has no pieces; other columns
    are ignored. With with_ids, ids holds each piece's ids as little-endian 32-bit integers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"
    made = mapped(own_columns(docs, "doc_id", "text"), _pieces(path, capacity, end_id, with_ids), schema)
    return saved(made if with_ids else made.drop("ids"), "pieces")


class _Counts:
    """How many pieces are left of each length; the lengths that are left are also bits of one integer."""

    def __init__(self, counts: dict[int, int]):
        self.of = {k: v for k, v in counts.items() if v}
        self.bits = sum(1 << k for k in self.of)

    def take(self, filling: Filling, times: int) -> None:
        for k in filling:
            left = self.of[k] - times
            if left:
                self.of[k] = left
            else:
                del self.of[k]
                self.bits &= ~(1 << k)

    def give(self, filling: Filling, times: int) -> None:
        for k in filling:
            self.of[k] = self.of.get(k, 0) + times
            self.bits |= 1 << k

    def largest(self, most: int) -> int:
        """The largest length that is left, of most at most; 0 if none is."""
        return (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.bits & ((1 << (most + 1)) - 1) else 0


class _Spent(Exception):
    """The search has taken all its steps."""


def _times(filling: Filling, counts: _Counts) -> int:
    """How often a filling can be applied."""
    return min(counts.of[k] // n for k, n in Counter(filling).items())


def _filled(filling: Filling, room: int, counts: _Counts) -> Filling:
    """Best fit: the largest piece that fits, again and again."""
    most = room
    while room and (k := counts.largest(min(room, most))):
        n = min(room // k, counts.of[k] - filling.count(k))
        filling, room, most = filling + (k,) * n, room - n * k, k - 1
    return filling


class _Search:
    def __init__(self, histogram: dict[int, int], capacity: int, steps_: int):
        self.counts, self.capacity, self.left = _Counts(histogram), capacity, steps_

    def _sums(self, room: int, most: int) -> Iterator[Filling]:
        """All choices, largest pieces first, of pieces left of most at most that fill the room exactly."""
        if not room:
            yield ()
            return
        counts = self.counts
        k = counts.largest(min(room, most))
        while k:
            self.left -= 1
            if self.left < 0:
                raise _Spent
            for n in range(min(room // k, counts.of[k]), 0, -1):
                rest = room - n * k
                if not rest or counts.bits & ((1 << min(k, rest + 1)) - 2):  # something that fits is left
                    for more in self._sums(rest, k - 1):
                        yield (k,) * n + more
            k = counts.largest(k - 1)

    def _dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a larger piece that is left could take the place of one of the filling's pieces, or of two."""
        own, all_ = Counter(filling[1:]), Counter(filling)
        free = lambda low, high: any(self.counts.of[k] > all_.get(k, 0) for k in range(low, high + 1) if k in self.counts.of)
        sizes = sorted(own)
        if any(free(k + 1, k + waste) for k in sizes):
            return True
        return any(free(x + y, x + y + waste) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or own[x] > 1)

    def fillings(self, most_waste: int, after: tuple[int, Filling]) -> Iterator[tuple[int, Filling]]:
        """(waste, lengths) of undominated fillings around the largest piece, least waste and then largest pieces first, from after on.

        A filling is not complete while a piece of its waste or less is left, so all of these are in it, whatever else is.
        """
        first = self.counts.largest(self.capacity)
        room = self.capacity - first
        self.counts.take((first,), 1)
        low = (self.counts.bits & -self.counts.bits).bit_length() - 1 if self.counts.bits else room + 1
        small = sorted((k, self.counts.of[k]) for k in self.counts.of if k <= room) if low <= min(most_waste, room) else []
        self.counts.give((first,), 1)
        for waste in range(max(0, after[0]), min(most_waste, room) + 1):
            forced = tuple(k for k, n in small if k <= waste for _ in range(min(n, room // k + 1)))[::-1] if waste >= low else ()
            rest = room - waste - sum(forced)
            if rest < 0:
                return  # more waste only forces more pieces into less room
            self.counts.take((first,), 1)
            for k in forced:
                self.counts.take((k,), 1)
            sums = self._sums(rest, rest)
            while True:  # the counts are as they were whenever a filling is handed out
                more = next(sums, None)
                for k in forced:
                    self.counts.give((k,), 1)
                self.counts.give((first,), 1)
                if more is None:
                    break
                filling = (first, *more, *forced)
                if (waste, tuple(-k for k in filling)) >= (after[0], tuple(-k for k in after[1])) and not self._dominated(filling, waste):
                    yield waste, filling
                self.counts.take((first,), 1)
                for k in forced:
                    self.counts.take((k,), 1)


@dataclass
class Packing:
    """(times, lengths) of all sequences, how many they are, the lower bound, and whether no packing has fewer."""

    bins: list[tuple[int, Filling]]
    sequences: int
    bound: int
    proven: bool


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, most_steps: int = STEPS) -> Packing:
    """A packing of histogram (length: pieces) into as few bins as possible; no pieces need none."""
    total = sum(k * v for k, v in histogram.items())
    bound = max(-(-total // capacity), sum(v for k, v in histogram.items() if 2 * k > capacity))
    search, best = _Search(histogram, capacity, most_steps), []
    counts = search.counts
    while first := counts.largest(capacity):  # best fit, the first incumbent
        filling = _filled((first,), capacity - first, counts)
        best.append((_times(filling, counts), filling))
        counts.take(filling, best[-1][0])
    fewest = sum(t for t, _ in best)
    search.counts = counts = _Counts(histogram)
    path: list[tuple[int, Filling]] = []
    used = wasted = 0

    def options(after: tuple[int, Filling]) -> Iterator[tuple[int, int, Filling]]:
        """(waste, times, filling) to try next; a better packing may waste no more than its bins have room for."""
        slack = lambda: (fewest - 1) * capacity - total - wasted
        for waste, filling in search.fillings(slack(), after):
            if waste > slack():
                return
            for times in range(_times(filling, counts), 0, -1):
                if waste * times <= slack():
                    yield waste, times, filling

    start = (0, (capacity + 1,))
    stack, proven = [options(start)], True
    try:
        while stack and fewest > bound:
            search.left -= 1
            if search.left < 0:
                raise _Spent
            found = next(stack[-1], None)
            if found is None:
                stack.pop()
                if path:
                    times, filling = path.pop()
                    counts.give(filling, times)
                    used, wasted = used - times, wasted - (capacity - sum(filling)) * times
                continue
            waste, times, filling = found
            counts.take(filling, times)
            path.append((times, filling))
            used, wasted = used + times, wasted + waste * times
            if not counts.of and used < fewest:
                fewest, best = used, list(path)
            same = counts.largest(capacity) == filling[0]  # fillings around pieces of one length come in their order
            stack.append(options((waste, filling) if same else start) if counts.of else iter(()))
    except _Spent:
        proven = False
    return Packing(best, fewest, bound, proven)


def rank_ranges(packing: list[tuple[int, Filling]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, pieces a bin, first sequence, offset in the sequence) of a packing."""
    rows, taken, sequence = [], {}, 0
    for times, filling in packing:
        offset = 0
        for k in sorted(set(filling), reverse=True):
            n, at = filling.count(k), taken.get(k, 0)
            rows.append((k, at, at + n * times, n, sequence, offset))
            taken[k], offset = at + n * times, offset + n * k
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, most_steps: int = STEPS) -> DataFrame:
    """pieces (of tokenized()) with sequence_id, offset, lower_bound (of the number of sequences) and optimal (whether it is proven that
    no packing has fewer); what reaches the driver is one count for each length. No pieces give no rows. The search takes most_steps at most;
    with enough of them it always ends with a proof."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}
    packing = complete_bins(histogram, capacity, most_steps)
    ranges = spark.createDataFrame(rank_ranges(packing.bins), "length long, low long, high long, each long, first long, base long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # ranges has no more rows than the capacity squared, whatever the number of pieces
    ranked = pieces.join(firsts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(ranges), (ranked["length"] == ranges["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).drop(ranges["length"])
    own = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(own / F.col("each"))).withColumn("offset", F.col("base") + own % F.col("each") * F.col("length"))
    placed = placed.withColumn("lower_bound", F.lit(packing.bound).cast("long")).withColumn("optimal", F.lit(packing.proven))
    return placed.drop("before", "rank", "low", "high", "each", "first", "base", "task", "nth")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "lower_bound", "optimal")


QUERIES = {"op6_best_fit_packing": (op6_best_fit_packing, None)}
