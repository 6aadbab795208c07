"""Edit replay against one that goes through the edits one by one, and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalogue, edits

EDIT = "seq long, kind string, root string, path string, document_id string"


def one_by_one(rows, folders, placements, most):
    folders, placed, out = set(folders), {d: (r, p) for d, r, p in placements}, {}
    under = lambda p, top: p == top or p.startswith(top + "/")
    for seq, kind, root, path, doc in sorted(rows):
        if kind == "create":
            out[seq] = "exists" if (root, path) in folders else "full" if len(folders) >= most else "created"
            folders |= {(root, path)} if out[seq] == "created" else set()
        elif kind == "remove":
            held = any(r == root and under(p, path) for r, p in placed.values()) or any(r == root and p != path and under(p, path) for r, p in folders)
            out[seq] = "absent" if (root, path) not in folders else "blocked" if held else "removed"
            folders -= {(root, path)} if out[seq] == "removed" else set()
        elif kind == "place":
            out[seq] = "moved" if doc in placed else "placed"
            placed[doc] = root, path
        else:
            out[seq] = {"clear": "cleared", "delete": "deleted"}[kind] if doc in placed else "nothing"
            placed.pop(doc, None)
    return out, folders, {(d, r, p) for d, (r, p) in placed.items()}


@pytest.mark.parametrize(("seed", "most"), [(1, 5000), (2, 4), (3, 9)])
def test_replay_equals_one_by_one(spark, seed, most):
    r = random.Random(seed)
    paths = ["a", "a/b", "a/b/c", "ab", "a/b c", "d", ""]
    rows = [(i, r.choice(["create", "create", "remove", "remove", "place", "clear", "delete"]), r.choice("RST"), r.choice(paths), r.choice("uvwxy")) for i in range(400)]
    folders, placements = [("R", "a"), ("S", "d")], [("u", "R", "a/b"), ("z", "S", "d")]
    df = spark.createDataFrame(rows, EDIT).orderBy(F.rand(1))
    got = edits.replay(df, spark.createDataFrame(folders, "root string, path string"), spark.createDataFrame(placements, "document_id string, root string, path string"), most)
    out, left, placed = one_by_one(rows, folders, placements, most)
    assert {x.seq: x.outcome for x in got[0].collect()} == out and got[0].count() == len(rows)
    assert {tuple(x) for x in got[1].collect()} == left
    assert {tuple(x) for x in got[2].collect()} == placed
    assert {"full" in out.values(), most < 10} == {most < 10}


def test_order_decides_conflicts(spark):
    rows = [
        (1, "create", "R", "a", None), (2, "create", "R", "a", None), (3, "place", "R", "a/x", "d"), (4, "remove", "R", "a", None), (5, "clear", None, None, "d"),
        (6, "create", "R", "a/b", None), (7, "remove", "R", "a", None), (8, "remove", "R", "a/b", None), (9, "remove", "R", "a", None), (10, "remove", "R", "a", None),
        (11, "clear", None, None, "d"), (12, "place", "R", "q", "d"), (13, "delete", None, None, "d"), (None, "create", "R", "z", None),
    ]
    df = spark.createDataFrame(rows, EDIT)
    none = df.where("false")
    out, folders, placed, gone = edits.replay(df, none.select("root", "path"), none.select("document_id", "root", "path"))
    want = "created exists placed blocked cleared created blocked removed removed absent nothing placed deleted".split()
    assert [x.outcome for x in out.orderBy("seq").collect()] == want
    assert folders.isEmpty() and placed.isEmpty() and [x[0] for x in gone.collect()] == ["d"]
    tables = {"chunks": spark.createDataFrame([("d", 1), ("e", 2)], "document_id string, n int"), "acl": spark.createDataFrame([("d", "p")], "document_id string, who string")}
    assert {k: v.count() for k, v in edits.cascaded(tables, gone).items()} == {"chunks": 1, "acl": 0}


def test_deletable_folders_by_ancestors(spark):
    folders = spark.createDataFrame([("R", p) for p in ("a", "a/b", "ab", "c", "d", "")], "root string, path string")
    placements = spark.createDataFrame([("R", "c"), ("R", "d/x"), ("S", "ab")], "root string, folder string")
    got = {x.path: x.blocked for x in catalogue.deletable(folders, placements).collect()}
    assert got == {"a": True, "a/b": False, "ab": False, "c": True, "d": True, "": False}
