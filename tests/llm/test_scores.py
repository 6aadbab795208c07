"""The class model's scores against a plain computation with its classes; the label path against all paths."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from folioscope.llm import brown_lm, language_id
from folioscope.llm.shared import hash_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def bucket_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(brown_lm.buckets_of(raw, np.array([0]), np.array([len(raw)]))[0])


def plain_scores(rows, classes, least):
    """log10 of each text by the definition: class transitions times emissions."""
    train = [tokens_of(t) for d, t in rows if not brown_lm.held_out(d)]
    counts = collections.Counter(w for t in train for w in t)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    unit = lambda w: signed(hash_of(w)) if counts[w] >= least else bucket_of(w)
    of = lambda w: classes[unit(w)]
    size, types, once, twice, pairs = (collections.Counter() for _ in range(5))
    for w, c in counts.items():
        size[of(w)] += c
        types[of(w)] += 1
        once[of(w)] += c == 1
        twice[of(w)] += c == 2
    size[0] = len(train)
    for t in train:
        path = [0, *map(of, t), 0]
        pairs.update(zip(path, path[1:], strict=False))
    n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    share = {c: (size[c] + 0.5) / (sum(size.values()) + 0.5 * brown_lm.CLASSES) for c in range(brown_lm.CLASSES)}
    after = collections.Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    step = lambda a, b: (pairs[a, b] + brown_lm.KAPPA * share[b]) / (after[a] + brown_lm.KAPPA)

    def emission(w):
        c = of(w)
        if counts[w]:
            return (counts[w] - discount) / size[c]
        there = max(1.0, once[c] ** 2 / (2 * twice[c]) if twice[c] else once[c] * (once[c] - 1) / 2)
        return (discount * types[c] / size[c] if size[c] else 1.0) / there

    out = []
    for d, t in rows:
        w = tokens_of(t)
        path = [0, *map(of, w), 0]
        out.append((d, sum(math.log10(step(a, b)) for a, b in zip(path, path[1:], strict=False)) + sum(math.log10(emission(x)) for x in w)))
    return out


@pytest.mark.parametrize(("least", "few"), [(5, 2_000_000), (5, 0), (1000, 2_000_000)])
def test_class_scores_equal_the_definition(spark, monkeypatch, least, few):
    monkeypatch.setattr(brown_lm, "UNIT_COUNT", least)
    monkeypatch.setattr(brown_lm, "SMALL_UNITS", few)
    r = random.Random(7)
    common = "the of and to in a is that for it".split()
    word = lambda: r.choice(common) if r.random() < 0.5 else "w" + str(int(r.expovariate(0.02)))
    rows = [(i, " ".join(word().title() if r.random() < 0.1 else word() for _ in range(r.randrange(0, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "é" * 3000 + " the"), (None, "of the w1")]
    df = spark.createDataFrame([(d, t, 1, "u") for d, t in rows], "doc_id long, text string, unit long, word string")
    scored, classes = brown_lm.scored_by_classes(df)
    of = {x[0]: x[1] for x in classes.select("unit", "class").collect()}
    got = sorted((x.doc_id or -1, x.score) for x in scored.collect())
    want = sorted((d or -1, s) for d, s in plain_scores(rows, of, least))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for (_, a), (_, b) in zip(got, want, strict=True))


def test_the_label_path_is_the_best_of_all_paths():
    r = np.random.default_rng(3)
    for _ in range(300):
        n, size, penalty = int(r.integers(1, 7)), int(r.integers(1, 4)), float(r.choice([0.0, 0.5, 2.0, 6.0]))
        scores = r.normal(0, 2, (n, size)).round(1) - (r.random((n, size)) < 0.1) * 50
        value = lambda p, s=scores, c=penalty: sum(s[i, k] for i, k in enumerate(p)) - c * sum(a != b for a, b in itertools.pairwise(p))
        best = max(value(p) for p in itertools.product(range(size), repeat=n))
        assert math.isclose(value(language_id.viterbi(scores, penalty)), best, abs_tol=1e-9)
        path = language_id.best_path(scores, penalty)
        assert math.isclose(value([path] * n if isinstance(path, int) else path), best, abs_tol=1e-9)


def test_languages_and_spans_of_mixed_texts(spark):
    words = {"xx": "alpha beta gamma delta".split(), "yy": "uno dos tres cuatro".split(), "zz": "слово дело тело поле".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(words[k], k=30)), k) for i, k in enumerate(["xx", "yy", "zz"] * 30)]
    mixed = " ".join(words["xx"] * 12) + " " + " ".join(words["yy"] * 12) + ". " + " ".join(words["zz"] * 5)
    rows += [(1000, mixed, None), (1001, "123 ...", "xx"), (1002, None, "xx"), (1003, "alpha " * 50000, None), (None, "uno dos", None)]
    got = {x.doc_id: x for x in language_id.identify(spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double")).collect()}
    assert all(got[d].lang_pred == k and got[d].score == 1.0 for d, _, k in rows[:90])
    assert [x.lang for x in got[1000].spans] == ["xx", "yy", "zz"] and got[1000].lang_pred == "xx"
    cut = [mixed[x.start : x.end] for x in got[1000].spans]
    assert cut[0].startswith("alpha") and cut[1].split()[0] == "uno" and cut[1].split()[-1] == "cuatro" and cut[2].split()[0] == "слово"
    assert got[1001].lang_pred == got[1002].lang_pred == "und" and got[1003].lang_pred == "xx" and got[None].lang_pred == "yy"
