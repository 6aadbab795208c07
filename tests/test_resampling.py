"""Draws and means of the bootstrap against md5 of the standard library, and without a row for a draw."""

import hashlib

import pytest

from folioscope.operators import resampling
from folioscope.operators.evaluation import bootstrap


def number(seed, sample, slot):
    return int(hashlib.md5(f"{seed}:{sample}:{slot}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("first,last,a,b", [(8, 12, 0, 120), (99, 101, 99990, 100010), (0, 1, 0, 17000)])
def test_draws_are_md5(first, last, a, b):
    got = {(s, start + j): int(x) for some, start, numbers in resampling.drawn(7, range(first, last), a, b) for s, own in zip(some, numbers, strict=True) for j, x in enumerate(own)}
    assert got == {(s, i): number(7, s, i) for s in range(first, last) for i in range(a, b)}


@pytest.mark.parametrize("values", [1 << 20, 7])
def test_means_of_groups_nulls_and_pieces(spark, monkeypatch, values):
    monkeypatch.setattr(resampling, "VALUES", values)
    rows = {"a": [float(i % 5) for i in range(23)], "b": [None if i % 4 == 1 else i / 3 for i in range(12)]}
    numbered = spark.createDataFrame([(g, i, len(v), x) for g, v in rows.items() for i, x in enumerate(v)], "g string, _i long, _n long, _v double")
    got = {(r.g, r._s): r._m for r in resampling.resampled(numbered, ["g"], 130, 7).collect()}
    for g, v in rows.items():
        for s in range(130):
            drawn = [x for i in range(len(v)) if (x := v[number(7, s, i) % len(v)]) is not None]
            assert got.pop((g, s)) == pytest.approx(sum(drawn) / len(drawn))
    assert not got


def test_no_row_is_made_for_a_draw(spark):
    rows = spark.createDataFrame([("g", f"q{i:02}", float(i % 3)) for i in range(30)], "g string, id string, v double")
    assert "Generate" not in bootstrap(rows, ["g"], "v", samples=100)._jdf.queryExecution().optimizedPlan().toString()
