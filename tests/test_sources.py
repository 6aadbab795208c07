"""Readers and writers of files."""

import json

from folioscope.operators import shaping
from folioscope.sources import files


def test_campaign_files_without_side_files(spark, tmp_path):
    run = tmp_path / "camp" / "r2" / "off"
    run.mkdir(parents=True)
    (run / "r1.json").write_text(json.dumps({"label": "a", "at": "t", "repeats": 2, "per_question": [{"id": "A01", "ok": True}, {"id": "A02"}]}, indent=1))
    (run / "r1.judge.json").write_text("{}")
    (run / "load.json").write_text("{}")
    records, manifests = files.read_campaign(spark, f"file://{tmp_path}", "id:string, ok:boolean")
    assert sorted(map(tuple, records.collect())) == [("r2", "off", 1, "A01", True), ("r2", "off", 1, "A02", None)]
    assert [tuple(r) for r in manifests.collect()] == [("r2", "off", 1, "a", "t", 2)]


def test_scan_of_a_folder(spark, tmp_path):
    for name in ("a.txt", "sub/b.TXT", "c.exe", ".hidden/d.txt", "__MACOSX/e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    good, bad = shaping.scan_files(spark, f"file:{tmp_path}", (".txt",))
    assert sorted(r.path.rsplit("/", 1)[1] for r in good.collect()) == ["a.txt", "b.TXT"]
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["c.exe"]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string").orderBy("a")
    assert files.markdown(df) == "| a | b |\n|---|---|\n| 1 |  |\n| 2 | x |"
    assert files.markdown(df, 1).endswith("more than 1 rows")
    files.write_report({"one": df}, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/one").count() == 2


def test_files_go_to_the_parser_of_their_extension(spark):
    rows = [("a/b.TXT", b"one\ftwo"), ("c.md", b""), ("d.e/f", b"x"), (None, b"y"), ("g.bin", b"z"), (".txt", b"w"), ("h.txt", None)]
    found = spark.createDataFrame(rows, "path string, content binary")
    pages, left = files.parse_by_extension(found, {"txt": files.text_pages, "md": files.text_pages})
    assert sorted(map(tuple, pages.collect())) == [("a/b.TXT", 1, "one"), ("a/b.TXT", 2, "two"), ("c.md", 1, "")]
    assert {x.path for x in left.collect()} == {"d.e/f", None, "g.bin", ".txt"}
    none, rest = files.parse_by_extension(found.where("false"), {"txt": files.text_pages})
    assert none.count() == rest.count() == 0
    everything, others = files.parse_by_extension(found, {})
    assert everything.count() == 0 and others.count() == len(rows)
