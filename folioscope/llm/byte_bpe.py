"""Byte-level BPE by recursive SQL.

Each partition holds a DuckDB database with the vocabulary and the merge table: (left id, right id, merged id), whose merged id
is the rank, for every split of a token into two tokens. A distinct pre-token that is no token itself becomes rows
(word, position, token); a recursive query joins neighbouring rows to the merge table and contracts each word's leftmost pair
of least rank until nothing merges. In a word of many bytes the other pairs of that rank come next, from left to right, until a contraction makes a pair of lower rank; there a round
contracts all of these, so that a word takes about as many rounds as it has ranks. Ids and decoded bytes come from ordered aggregation.

A query recurses as many rounds as keep its rows within ROWS and then starts again from its last state. A long pre-token is cut where no
token of the vocabulary matches its bytes on both sides of the cut: no merge can ever cross it, so its parts are words of their own.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import mapped, own_columns, table

#: Words that one recursive query takes, bytes in them, its rounds, and rows of all its rounds.
WORDS, WORD_BYTES, ROUNDS, ROWS = 40_000, 400_000, 48, 2_000_000
#: Code points of a pre-token that is cut, and bytes of one that is contracted by ranks.
LONG, MANY = 200, 48
#: Bytes that the pre-tokens which a Python worker remembers take, or about, besides as many of older ones; when they are more it forgets the older ones.
REMEMBERED = 96 << 20

_SPLIT = """
CREATE TEMP TABLE splits AS
SELECT cast(a.id AS BIGINT) AS l, cast(b.id AS BIGINT) AS r, cast(v.id AS BIGINT) AS merged
FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS cut FROM vocabulary) v
JOIN vocabulary a ON a.hex = v.hex[:cut] JOIN vocabulary b ON b.hex = v.hex[cut + 1:];
CREATE TEMP TABLE merges AS
SELECT l * 65536 + r AS pair, merged, merged IN (SELECT l FROM splits WHERE merged < l UNION SELECT r FROM splits WHERE merged < r) AS alone FROM splits
"""

#: k is a row's word and position, follower the k of the next row; low is a pair's rank, then its position.
_CONTRACT_PAIR = """
WITH RECURSIVE state(round, w, k, follower, token) AS (
  SELECT 0, w, k, follower, token FROM start
  UNION ALL
  (WITH pairs AS (
    SELECT s.w, s.k, t.k AS gone, t.follower, merged * 4294967296 + s.k % 4294967296 AS low
    FROM state s JOIN state t ON t.k = s.follower JOIN merges ON pair = s.token * 65536 + t.token WHERE s.round < {rounds}
  ), best AS (
    SELECT pairs.* FROM pairs JOIN (SELECT w, min(low) AS low FROM pairs GROUP BY w) USING (w, low)
  )
  SELECT round + 1, s.w, s.k, CASE WHEN s.k = b.k THEN b.follower ELSE s.follower END, CASE WHEN s.k = b.k THEN low // 4294967296 ELSE token END
  FROM state s JOIN best b ON s.w = b.w WHERE s.k <> b.gone)
)
SELECT s.w, k, follower, token, round FROM state s JOIN (SELECT w, max(round) AS last FROM state GROUP BY w) l ON l.w = s.w AND round = last
"""

#: The same for words of many bytes, by ranks: pairs of one rank that share a token are a chain, of which every other one is contracted.
#: alone: the merged token is part of a token of lower rank, so that its neighbours are looked at; waiting has the first that makes such a pair.
_CONTRACT_RANK = """
WITH RECURSIVE state(round, w, k, follower, token) AS (
  SELECT 0, w, k, follower, token FROM start
  UNION ALL
  (WITH pairs AS (
    SELECT s.w, s.k, t.k AS gone, t.follower, merged, alone
    FROM state s JOIN state t ON t.k = s.follower JOIN merges ON pair = s.token * 65536 + t.token WHERE s.round < {rounds}
  ), least AS (
    SELECT p.*, row_number() OVER (PARTITION BY p.w ORDER BY k) AS nth, lag(gone) OVER (PARTITION BY p.w ORDER BY k) IS NOT DISTINCT FROM k AS joined
    FROM pairs p JOIN (SELECT w, min(merged) AS low FROM pairs GROUP BY w) m ON m.w = p.w AND merged = low
  ), chains AS (
    SELECT *, nth - max(CASE WHEN joined THEN 0 ELSE nth END) OVER (PARTITION BY w ORDER BY k ROWS UNBOUNDED PRECEDING) AS place FROM least
  ), chosen AS (
    SELECT *, lag(follower) OVER (PARTITION BY w ORDER BY k) IS NOT DISTINCT FROM k AS beside FROM chains WHERE place % 2 = 0
  ), beside_them AS (
    SELECT c.w, c.k, c.merged AS own, (CASE WHEN beside THEN c.merged ELSE p.token END) * 65536 + c.merged AS pair FROM chosen c JOIN state p ON p.follower = c.k WHERE c.alone
    UNION ALL SELECT c.w, c.k, c.merged, c.merged * 65536 + x.token FROM chosen c JOIN state x ON x.k = c.follower WHERE c.alone
  ), waiting AS (
    SELECT w, min(k) AS k FROM beside_them JOIN merges USING (pair) WHERE merged < own GROUP BY w
  ), best AS (
    SELECT c.* FROM chosen c LEFT JOIN waiting u ON u.w = c.w WHERE u.k IS NULL OR c.k <= u.k
  )
  SELECT round + 1, s.w, s.k, coalesce(b.follower, s.follower), coalesce(b.merged, token)
  FROM state s SEMI JOIN best d ON s.w = d.w ANTI JOIN best g ON s.k = g.gone LEFT JOIN best b ON s.k = b.k)
)
SELECT s.w, k, follower, token, round FROM state s JOIN (SELECT w, max(round) AS last FROM state GROUP BY w) l ON l.w = s.w AND round = last
"""

_COLLECTED = """
SELECT w, array_to_string(list_transform(x, lambda t: t.id), ','), array_to_string(list_transform(x, lambda t: t.hex), '')
FROM (SELECT w, list({'id': id, 'hex': hex} ORDER BY k) AS x FROM (FROM whole UNION ALL FROM done) JOIN vocabulary ON id = token GROUP BY w)
"""


class Codec:
    """Encodes pre-tokens in one DuckDB database of its own."""

    def __init__(self, path: str):
        import duckdb

        self.path = path
        pairs = [line.split() for line in open(path, "rb")]
        beside = tempfile.mkdtemp(prefix="folioscope-")  # only for words that don't fit
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": beside})
        self.db.register("given", pa.table({"id": pa.array([int(b) for _, b in pairs], pa.int32()), "hex": [base64.b64decode(a).hex() for a, _ in pairs]}))
        self.db.execute("CREATE TEMP TABLE vocabulary AS SELECT id, hex FROM given")
        self.db.execute(_SPLIT)
        self.db.unregister("given")
        self.known: dict[str | bytes, tuple[str, bytes]] = {}
        self.older: dict[str | bytes, tuple[str, bytes]] = {}
        self.size = 0
        self.tokens = {base64.b64decode(a): int(b) for a, b in pairs}
        self.singles = np.array([self.tokens.get(bytes([x]), -1) for x in range(256)], np.int64)
        self.beginnings: set[bytes] = set()

    def parts(self, word: str) -> list[str | bytes]:
        """The word itself, or the bytes of a long word's parts: no token reaches from one into the next."""
        if len(word) <= LONG:
            return [word]
        self.beginnings = self.beginnings or {t[:n] for t in self.tokens for n in range(1, len(t))}
        data, out, first, reach = word.encode(), [], 0, 0
        for i in range(len(data)):
            if i >= reach and i > first:
                out.append(data[first:i])
                first = i
            end = i + 1
            reach = max(reach, end)
            while end <= len(data) and (piece := data[i:end]) in self.beginnings or piece in self.tokens:
                if piece in self.tokens:
                    reach = max(reach, end)
                end += 1
                if end > len(data):
                    break
        return [*out, data[first:]]

    def _contracted(self, by_rank: bool) -> None:
        """Contract start until its fixpoint; done then holds the final rows."""
        contract = _CONTRACT_RANK if by_rank else _CONTRACT_PAIR
        self.db.execute("CREATE OR REPLACE TEMP TABLE done (w BIGINT, k BIGINT, token BIGINT)")
        while rows := self.db.execute("SELECT count(*) FROM start").fetchall()[0][0]:
            rounds = max(1, min(ROUNDS, ROWS // rows))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE result AS {contract.format(rounds=rounds)}")
            self.db.execute(f"INSERT INTO done SELECT w, k, token FROM result WHERE round < {rounds}")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE start AS SELECT w, k, follower, token FROM result WHERE round = {rounds}")

    def learn(self, wanted: set[str | bytes]) -> None:
        """Have the ids (as decimal text) and the decoded bytes of all wanted words; others may be forgotten."""
        if self.size > REMEMBERED:
            self.known, self.older, self.size = {}, self.known, 0
        fresh = []
        for word in wanted - self.known.keys():
            if word in self.older:
                self.known[word] = self.older[word]
            else:
                fresh.append(word)
            self.size += 6 * len(word) + 250  # the word, its ids and bytes, and the table's own share
        length = lambda word: len(word if isinstance(word, bytes) else word.encode())
        for by_rank in (False, True):
            group, size = [], 0
            for word in fresh:
                if (length(word) > MANY) == by_rank:
                    group.append(word)
                    size += length(word)
                    if len(group) >= WORDS or size >= WORD_BYTES:
                        self._encode(group, by_rank)
                        group, size = [], 0
            if group:
                self._encode(group, by_rank)

    def _encode(self, group: list[str | bytes], by_rank: bool) -> None:
        """A word that is a token is not contracted; a part of a word is, whatever it is."""
        whole = {w: self.tokens[x.encode()] for w, x in enumerate(group) if isinstance(x, str) and x.encode() in self.tokens}
        words = [(w, x if isinstance(x, bytes) else x.encode()) for w, x in enumerate(group) if w not in whole]
        lengths = np.array([len(x) for _, x in words], np.int64)
        own, place = np.repeat(np.array([w for w, _ in words], np.int64), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        k = own * (1 << 32) + place
        follower = np.where(place + 1 < np.repeat(lengths, lengths), k + 1, -1)
        for name, columns in {
            "whole": {"w": list(whole), "k": [w << 32 for w in whole], "token": list(whole.values())},
            "start": {"w": own, "k": k, "follower": follower, "token": self.singles[np.frombuffer(b"".join([x for _, x in words]), np.uint8)]},
        }.items():
            self.db.register("given", pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self._contracted(by_rank)
        for w, ids, decoded in self.db.execute(_COLLECTED).fetchall():
            self.known[group[w]] = ids, bytes.fromhex(decoded)

    def text(self, parts: list[str | bytes]) -> tuple[str, bytes]:
        """The ids of a text's pre-tokens, joined by commas, and the bytes that they decode to."""
        found = [self.known[x] for x in parts]
        return ",".join([x[0] for x in found]), b"".join([x[1] for x in found])


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(path: str, pattern: str, digest: bool):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        codec, split = _codec(path), regex.compile(pattern).findall
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                parts, size, first = [], 0, at
                while at < batch.num_rows and (at == first or size < 1 << 20):
                    text = texts[at].as_py() or ""
                    words = split(text)
                    if max(map(len, words), default=0) > LONG:
                        words = [x for word in words for x in codec.parts(word)]
                    parts.append(words)
                    size += len(text)
                    at += 1
                codec.learn(set().union(*parts))
                rows = [codec.text(x) for x in parts]
                own = ids.slice(first, at - first)
                if digest:
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array([a.count(",") + 1 if a else 0 for a, _ in rows], pa.int64()), pa.array([hashlib.sha256(a.encode()).hexdigest() for a, _ in rows]), pa.array([hashlib.sha256(b).hexdigest() for _, b in rows])],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    lists = pa.array([list(map(int, a.split(","))) if a else [] for a, _ in rows], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([own, lists, pa.array([b for _, b in rows], pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids and decoded; or with digest n_tokens, ids_sha256 and decoded_sha256.

    The vocabulary at path (rank file) is read on the executors. A null or empty text has no ids; repeated rows give repeated
    results; an empty table gives none; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded binary"
    return mapped(own_columns(docs, "doc_id", "text"), _encoded(path, pattern, digest), schema)


def _decoded(path: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _codec(path).db
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                db.register("given", pa.table({"r": pa.array(range(part.num_rows), pa.int32()), "ids": part.column(1)}))
                rows = db.execute(
                    "SELECT r, string_agg(hex, '' ORDER BY p) FROM (SELECT r, ids[p] AS id, p FROM (SELECT r, ids, unnest(range(1, len(ids) + 1)) AS p FROM given)) JOIN vocabulary USING (id) GROUP BY r"
                ).fetchall()
                db.unregister("given")
                found = dict(rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes.fromhex(found.get(r, "")) for r in range(part.num_rows)], pa.binary())], ["doc_id", "decoded"])

    return decoded


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of ids, by joining id rows to the vocabulary and aggregating in order; unknown ids give none."""
    return mapped(own_columns(rows, "doc_id", "ids"), _decoded(path), "doc_id long, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


QUERIES = {"op2_byte_bpe": (op2_byte_bpe, None)}
