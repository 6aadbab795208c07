"""Draws of a bootstrap: a draw is the md5 of seed, sample and slot, so that any engine draws the same. Digests are worked out for thousands of slots at once,
and no row is made for a draw: a task draws for a range of samples, and gives a sum for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.retrieval import small
from folioscope.plans.ship import ship

#: Samples of a task, slots that are digested at once, values of a row, and bytes of values that a task holds.
SAMPLES, SLOTS, VALUES, HELD = 100, 16384, 1 << 20, 1 << 26
_ADDED = [int(abs(np.sin(i + 1.0)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(message: list[np.ndarray | int]) -> np.ndarray:
    """The first 32 bits, as a number, of md5 digests of messages of one block: its sixteen words, each a number or an array of numbers."""
    shape = next(w.shape for w in message if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = message[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f), np.add(f, np.uint32(_ADDED[i]), out=f)
        else:
            np.add(f, np.uint32((_ADDED[i] + word) & 0xFFFFFFFF), out=f)
        by = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=g), np.right_shift(f, np.uint32(32 - by), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


def _words(head: bytes, slots: np.ndarray, digits: int) -> list[np.ndarray | int]:
    """The words of messages of head and a slot of so many digits; head is filled in by drawn() where it is all zero here."""
    block = np.zeros((len(slots), 64), np.uint8)
    for k in range(digits):
        block[:, len(head) + digits - 1 - k] = slots // 10**k % 10 + 48
    size = len(head) + digits
    block[:, size] = 0x80
    block[:, 56:60] = np.array([size * 8], np.uint32).view(np.uint8)
    words = block.view("<u4")
    first, last = len(head) // 4, size // 4
    return [np.ascontiguousarray(words[:, k]) if first <= k <= last else int(words[0, k]) for k in range(16)]


def drawn(seed: object, samples: range, a: int, b: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """(samples, first slot, numbers by sample and slot) of the draws of slots a to b, about SLOTS at a time: numbers are the first 32 bits of md5("seed:sample:slot")."""
    heads = [f"{seed}:{s}:".encode() for s in samples]
    while a < b:
        digits = len(str(a))
        end = min(b, a + SLOTS, 10**digits)
        slots = np.arange(a, end)
        for size in sorted(set(map(len, heads))):
            if size + digits > 55:
                raise ValueError("seed, sample and slot must fit one block of md5")
            plain, of_size = _words(bytes(size), slots, digits), [k for k, h in enumerate(heads) if len(h) == size]
            step = max(1, SLOTS // len(slots))
            for some in (of_size[i : i + step] for i in range(0, len(of_size), step)):
                own = np.array([np.frombuffer(heads[k].ljust(64, b"\0"), "<u4") for k in some])
                flat = [np.bitwise_or(own[:, k, None], w).ravel() if isinstance(w, np.ndarray) or np.ptp(own[:, k]) else int(own[0, k]) | w for k, w in enumerate(plain)]
                flat = [np.repeat(w, len(slots)) if isinstance(w, np.ndarray) and len(w) == len(some) != len(some) * len(slots) else w for w in flat]
                yield [samples[k] for k in some], a, first_words(flat).reshape(len(some), -1)
        a = end


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other and are of the same samples, up to HELD bytes of values."""
    rows, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            values = batch.column("_values")[k].values
            row = {n: batch.column(n)[k] for n in batch.schema.names if n != "_values"}
            row["known"] = None if values.null_count == 0 else pc.is_valid(values).to_numpy(zero_copy_only=False)
            row["values"] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).copy()
            if rows and (rows[0]["_range"] != row["_range"] or size + 8 * len(row["values"]) > HELD):
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += 8 * len(row["values"])
    if rows:
        yield rows


def _summed(by: list[str], seed: object, samples: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches):
            first = rows[0]["_range"].as_py() * SAMPLES
            own = range(first, min(first + SAMPLES, samples))
            total, count = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)), np.int64)
            sizes = [r["_n"].as_py() for r in rows]
            starts = [r["_piece"].as_py() * VALUES for r in rows]
            for some, a, numbers in drawn(seed, own, 0, max(sizes)):
                places = np.array(some) - first
                for k, row in enumerate(rows):
                    n, values = sizes[k], row["values"]
                    at = numbers[:, : max(0, n - a)]
                    at = at % np.uint32(n) if n < 1 << 32 else at
                    inside = None if len(values) == n else (at >= starts[k]) & (at < starts[k] + len(values))
                    if inside is not None:
                        at = np.where(inside, at - np.uint32(starts[k]), 0)
                    known = row["known"][at] if row["known"] is not None else None
                    counted = known if inside is None else inside if known is None else inside & known
                    total[k, places] += (values[at] if counted is None else np.where(counted, values[at], 0.0)).sum(axis=1)
                    count[k, places] += at.shape[1] if counted is None else counted.sum(axis=1)
            for k, row in enumerate(rows):
                keys = [pa.array([row[c].as_py()] * len(own), row[c].type) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(own, pa.int32()), pa.array(total[k]), pa.array(count[k])], [*by, "_s", "_sum", "_count"])

    return summed


def resampled(numbered: DataFrame, by: list[str], samples: int, seed: object) -> DataFrame:
    """(by, _s, _m): the mean of each resample of each group of numbered (by, _i from 0, _n rows of the group, _v). Nulls are drawn, and left out of the mean.

    A group's values go to the tasks in rows of VALUES; a group of more than HELD bytes has its draws made again for each HELD of them.
    """
    ship(numbered.sparkSession)
    values = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"].cast("double")).alias("_values")
    pieces = numbered.groupBy(*by, "_n", F.floor(F.col("_i") / VALUES).cast("int").alias("_piece")).agg(values)
    ranges = -(-samples // SAMPLES)
    tasks = numbered.sparkSession.range(0, ranges, 1, ranges).select(F.col("id").cast("int").alias("_range")).crossJoin(small(pieces))
    kinds = ", ".join(f"`{c}` {dict(numbered.dtypes)[c]}" for c in by)
    sums = tasks.mapInArrow(_summed(by, seed, samples), ", ".join(filter(None, [kinds, "_s int, _sum double, _count long"])))
    return sums.groupBy(*by, "_s").agg((F.sum("_sum") / F.nullif(F.sum("_count"), F.lit(0))).alias("_m"))
