"""Language identification of whole texts and of their spans.

Per language, smoothed frequencies of hashed letter trigrams (with word bounds) are learned from labelled documents, and the
scripts that its letters are of. A word's script narrows the languages that it can have; its score in each is the sum of its
trigrams' log frequencies. The label sequence is the Viterbi path over the words with a penalty for each switch. For most texts no
stretch of words gains half a penalty in another language, which proves that the path never switches; the others' path is walked.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.brown_lm import held_out
from folioscope.llm.shared import fold_of, mapped, own_columns, saved, steps, table, text_buffer

#: Labelled documents that are learned from at most (those of least id hash), trigram buckets, and the penalty of a switch (nats).
LEARNED, TRIGRAMS, PENALTY = 20_000, 1 << 16, 24.0
#: A language has the scripts of this share of its letters.
SCRIPT_SHARE = 0.01
#: Where ranges of code points begin, and the script of each (0: none of these).
RANGES = (
    (0x0000, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10), (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 13),
    (0x1380, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 1), (0x2E80, 14), (0x3040, 15), (0x3100, 14), (0x3130, 12), (0x3190, 15),
    (0x3400, 14), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 14), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFF00, 1),
    (0xFF66, 15), (0xFFA0, 12), (0x10000, 0), (0x20000, 14), (0x40000, 0),
)
SCRIPTS = 16

_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case letter or mark (0: neither), script; and which are letters."""
    if not _TABLES:
        lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for (a, kind), (b, _) in zip(RANGES, [*RANGES[1:], (0x110000, 0)], strict=True):
            script[a:b] = kind
        letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                low = chr(c).lower()
                lower[c], letter[c] = ord(low[0]), kind[0] == "L"
        _TABLES.extend((lower, script, letter))
    return _TABLES[0], _TABLES[1], _TABLES[2]


@dataclass
class Words:
    """Words (letters and marks in a row) of some texts: of each character its bucket; of each word its first character in
    that list, start and end in the step's code points, script; bounds: each text's words; first: its first code point."""

    buckets: np.ndarray
    firsts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    bounds: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    lower, script, letter = _letters()
    raw = data[int(offsets[0]) : int(offsets[-1])]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    counted = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    cuts = counted[offsets - offsets[0]]
    n, low = len(points), lower[points]
    solid = low > 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    before[inner] = after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    own = np.flatnonzero(solid)
    left, right = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[~before], right[~after] = 0, 0
    with np.errstate(over="ignore"):
        code = (left[own] * np.uint64(0x9E3779B97F4A7C15)) ^ (low[own].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right[own] * np.uint64(0x165667B19E3779F9))
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    firsts = np.concatenate(([0], np.cumsum(ends - starts)[:-1])) if len(starts) else starts
    if len(starts):  # words of marks alone have no letters
        lettered = np.add.reduceat(letter[points[own]].astype(np.int64), firsts) > 0
    else:
        lettered = np.zeros(0, bool)
    kinds = np.where(lettered, script[points[starts]], 255).astype(np.int64)
    return Words((code >> np.uint64(48)).astype(np.int64) & (TRIGRAMS - 1), firsts, starts, ends, kinds, np.searchsorted(starts, cuts), cuts[:-1])


def _learned(langs: list[str]):
    number = {x: i for i, x in enumerate(langs)}

    def learned(batches):
        counts = np.zeros((len(langs), TRIGRAMS + SCRIPTS), np.int64)
        for batch in batches:
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            data, offsets = text_buffer(batch.column("text"))
            for a, b in steps(offsets):
                w = words_of(data, offsets[a : b + 1])
                of_word = np.repeat(which[a:b], np.diff(w.bounds))
                np.add.at(counts, (np.repeat(of_word, w.ends - w.starts), w.buckets), 1)
                known = w.scripts < 255
                np.add.at(counts, (of_word[known], TRIGRAMS + w.scripts[known]), (w.ends - w.starts)[known])
        at = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(counts[at[:, 0], at[:, 1]])], ["lang", "feature", "c"])

    return learned


@dataclass
class Model:
    langs: list[str]
    #: log frequency by trigram bucket and language; which languages a script's words can have
    scores: np.ndarray
    able: np.ndarray


def fit(docs: DataFrame, limit: int = LEARNED) -> Model:
    """Learn from documents with text and lang that aren't held out; the model has a row of TRIGRAMS numbers for each language."""
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(fold_of("doc_id", 4) != 2)
    chosen = usable.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).distinct()
    texts = own_columns(usable, "doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("text", "lang")
    texts = saved(texts, "labelled")
    langs = sorted(r[0] for r in texts.select("lang").distinct().collect())
    counts = np.zeros((len(langs), TRIGRAMS + SCRIPTS))
    rows = mapped(texts, _learned(langs), "lang long, feature long, c long").groupBy("lang", "feature").agg(F.sum("c").alias("c")).toArrow()
    counts[rows.column("lang").to_numpy(), rows.column("feature").to_numpy()] = rows.column("c").to_numpy()
    grams, scripts = counts[:, :TRIGRAMS] + 0.1, counts[:, TRIGRAMS:]
    scores = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32) if langs else np.zeros((TRIGRAMS, 0), np.float32)
    return Model(langs, np.ascontiguousarray(scores), (scripts > SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)).T)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each row of scores (word, language), ties to the smaller language."""
    n, size = scores.shape
    total, came = scores[0].copy(), np.zeros((n, size), np.int64)
    stay = np.arange(size)
    for t in range(1, n):
        top = int(total.argmax())
        moved = total[top] - penalty > total
        came[t] = np.where(moved, top, stay)
        total = np.where(moved, total[top] - penalty, total) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray | int:
    """viterbi(), as one number where a bound proves that it never switches: every stretch's gain in another language is
    half a penalty at most, so that its one or two switches cost more, and a path without the best language loses too."""
    sums = scores.cumsum(axis=0)
    top = int(sums[-1].argmax())
    gains = np.vstack((np.zeros(sums.shape[1]), sums - sums[:, top : top + 1]))
    if (gains - np.minimum.accumulate(gains, axis=0)).max() <= penalty / 2:
        return top
    return viterbi(scores, penalty)


def _labelled(shared):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            data, offsets = text_buffer(batch.column("text"))
            for a, b in steps(offsets, 1 << 19):
                w = words_of(data, offsets[a : b + 1])
                lettered = w.scripts < 255
                scores = np.add.reduceat(m.scores[w.buckets], w.firsts, axis=0).astype(np.float64) if len(w.starts) and m.langs else np.zeros((len(w.starts), len(m.langs)))
                if m.langs and len(scores):
                    able = m.able[np.where(lettered, w.scripts, 0)]
                    none = ~able.any(axis=1) | ~lettered  # no language has the script: the word says nothing
                    scores[~able] = -1e6
                    scores[none] = 0.0
                sizes = w.ends - w.starts
                for i in range(a, b):
                    x, y = int(w.bounds[i - a]), int(w.bounds[i - a + 1])
                    if not m.langs or not lettered[x:y].any():
                        rows.append((ids[i], "und", 0.0, []))
                        continue
                    path, at = best_path(scores[x:y]), int(w.first[i - a])
                    if isinstance(path, int):
                        rows.append((ids[i], m.langs[path], 1.0, [(int(w.starts[x]) - at, int(w.ends[y - 1]) - at, m.langs[path])]))
                        continue
                    share = np.bincount(path, weights=sizes[x:y], minlength=len(m.langs))
                    top = int(share.argmax())
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), y - x]
                    spans = [(int(w.starts[x + p]) - at, int(w.ends[x + q - 1]) - at, m.langs[path[p]]) for p, q in zip(cuts, cuts[1:], strict=False)]
                    rows.append((ids[i], m.langs[top], float(share[top] / share.sum()), spans))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array([held_out(x, 4) for x in columns[0]], pa.bool_()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x] for x in columns[3]], span)],
                ["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    return labelled


def identify(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score and spans (start, end in code points, lang).

    lang_pred labels most letters (ties: the first in alphabetical order) and score is its share of them. Text without letters, null or
    empty is ``und`` with score 0 and no span, as is every text if nothing was learned. lang is only learned from, where
    the row isn't held out. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return mapped(own_columns(docs, "doc_id", "text"), _labelled(model), "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op9_language_id": (op9_language_id, None)}
