"""The SQL of the manifest follows the operator's tree of digests at any number of levels."""

import pytest

duckdb = pytest.importorskip("duckdb")

from folioscope.plans import registry  # noqa: E402


@pytest.mark.parametrize("documents", [900, 1100, 16100])
def test_manifest_equals_its_sql(spark, tmp_path, documents):
    duckdb.sql(f"COPY (SELECT i AS doc_id, i % 2 AS quality, 0 AS toxic FROM range({documents}) r(i)) TO '{tmp_path}/labels.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT i AS doc_id, 'a line' AS text, 'en' AS lang, 's' AS source, 6 AS n_chars FROM range({documents}) r(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    df = registry.QUERIES["i17_manifest"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("labels", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    found = c.execute(registry.ORACLES["i17_manifest"])
    names = [x[0] for x in found.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
