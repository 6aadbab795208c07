"""Long pre-tokens, proofs of packings, and a ledger that scans nothing twice."""

import base64
import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from folioscope.llm import byte_bpe, packing, secret_scan

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, ids string, k int"


def test_long_pre_tokens_equal_the_library(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    alphabets = [string.ascii_lowercase, string.digits, "é", "x", "abcdeéñß漢字", "!?.,;-_=+*/", " ", "🙂", "क्षत्रियहि"]
    rows = [(i, "".join(r.choices(a, k=100_000))) for i, a in enumerate(alphabets)] + [(90, "the" * 33_333), (91, "ab" * 50_000), (None, "é" * 40_000), (92, None)]
    got = byte_bpe.encode(spark.createDataFrame([(*x, "z", 1) for x in rows], DOCS), path, P.PATTERN, digest=True).collect()
    hashed = lambda data: hashlib.sha256(data).hexdigest()
    want = {d: (len(i := library.encode_ordinary(t or "")), hashed(",".join(map(str, i)).encode()), hashed((t or "").encode())) for d, t in rows}
    assert {x.doc_id: tuple(x)[1:] for x in got} == want


def test_cuts_and_batches_of_pairs_equal_the_library(monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = byte_bpe.Codec(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.tokens, special_tokens={})
    import regex

    split, r = regex.compile(P.PATTERN).findall, random.Random(9)
    for long in (3, 12, 200):
        monkeypatch.setattr(byte_bpe, "LONG", long)
        texts = ["".join(r.choices(r.choice([string.ascii_lowercase, "abc", "éèaà", "the in", "漢字かな", "<>=!-"]), k=r.randrange(1, 60))) for _ in range(1500)]
        keys = [[x for word in split(t) for x in codec.parts(word)] for t in texts]
        codec.learn(set().union(*keys))
        assert [codec.text(k) for k in keys] == [(",".join(map(str, library.encode_ordinary(t))), t.encode()) for t in texts]


def fewest_bins(pieces, capacity):
    """By all subsets: the least bins, and the least that the last of them holds."""
    best = [(1, 0)] + [(99, 0)] * ((1 << len(pieces)) - 1)
    for mask in range(1, len(best)):
        for i, k in enumerate(pieces):
            if mask >> i & 1:
                n, used = best[mask ^ (1 << i)]
                best[mask] = min(best[mask], (n, used + k) if used + k <= capacity else (n + 1, k))
    return best[-1][0]


def test_no_false_proof_of_a_packing():
    assert packing.complete_bins({1: 1, 3: 5, 5: 1, 9: 2, 11: 1}, 17).sequences == 3
    r, above = random.Random(2), 0
    for _ in range(4000):
        capacity, n = r.choice([7, 10, 12, 17, 20, 31]), r.randrange(1, 9)
        pieces = [r.randint(1, r.choice([capacity, capacity // 2, capacity // 3 + 1])) for _ in range(n)]
        found = packing.complete_bins({k: pieces.count(k) for k in pieces}, capacity)
        least = fewest_bins(pieces, capacity)
        assert found.proven and found.sequences == least, (capacity, pieces, found)
        above += least > found.bound
    assert above > 50


def test_ledger_adds_only_what_is_new(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ledger"
    old = [(1, "password = hunter22", "z", 1), (2, "token=abcdef1", "z", 1), (2, "token=abcdef1", "z", 1), (None, "nothing", "z", 1)]
    docs = spark.createDataFrame(old, DOCS)
    counts = lambda: tuple(spark.read.parquet(f"{folder}/{x}").count() for x in ("findings", "ledger"))
    rows = lambda df: sorted((x.doc_id or 0, len(x.spans)) for x in df.collect())
    assert rows(secret_scan.scan_with_ledger(docs, folder)) == [(0, 0), (1, 1), (2, 1), (2, 1)]
    assert counts() == (2, 3 * len(secret_scan.RULES))
    tried = []
    real = secret_scan._matching
    monkeypatch.setattr(secret_scan, "_matching", lambda df, rules: tried.append((sorted(r.text for r in df.collect()), [r.kind for r in rules])) or real(df, rules))
    assert rows(secret_scan.scan_with_ledger(docs, folder)) == [(0, 0), (1, 1), (2, 1), (2, 1)]
    assert tried == [] and counts() == (2, 3 * len(secret_scan.RULES))  # nothing is new: no pattern is tried, nothing is added
    more = spark.createDataFrame([*old, (5, "secret: abcdefgh", "z", 1), (6, "token=abcdef1", "z", 1)], DOCS)
    assert rows(secret_scan.scan_with_ledger(more, folder)) == [(0, 0), (1, 1), (2, 1), (2, 1), (5, 1), (6, 1)]
    assert tried == [(["secret: abcdefgh"], [r.kind for r in secret_scan.RULES])]
    assert counts() == (3, 4 * len(secret_scan.RULES))
    rule = secret_scan.Rule("word", 1, "not[h]ing", 0, 1)
    tried.clear()
    assert rows(secret_scan.scan_with_ledger(more, folder, (*secret_scan.RULES, rule)))[0] == (0, 1)
    assert [kinds for _, kinds in tried] == [["word"]] and counts() == (4, 4 * len(secret_scan.RULES) + 4)
    assert secret_scan.scan_with_ledger(more.where(F.lit(False)), folder).count() == 0


def test_a_large_number_of_unseen_blobs_is_joined_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "token=abcdef1", "z", 1), (2, "token=abcdef2", "z", 1)], DOCS)
    _, found, ledger = secret_scan.scan(docs.where("doc_id = 1"))
    monkeypatch.setattr(secret_scan, "FEW_BLOBS", 0)
    out, new, pairs = secret_scan.scan(docs, ledger, found)
    assert sorted((x.doc_id, len(x.spans)) for x in out.collect()) == [(1, 1), (2, 1)]
    assert new.count() == 1 and pairs.count() == len(secret_scan.RULES)
