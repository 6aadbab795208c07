"""The quality model learns from every trusted text, whatever the sizes at which its work is parted."""

import pytest

from folioscope.llm import quality
from tests.llm.test_llm import brute_kneser_ney, docs_of, prose


def test_every_trusted_text_is_learned_from(spark):
    rows = [(i, f"only{i} text", "en") for i in range(4000)] + [(4000, "long " * 4_000_000, "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_ids(labels)
    assert quality.sample(docs_of(spark, rows), trusted).count() == trusted.where("fold <> 0").count() > 3000


def test_parts_and_bounds_change_no_score(spark, monkeypatch):
    train = [prose(i, 40) for i in range(60)] + ["go go go go on", ""]
    texts = [prose(i, 30) for i in range(50, 70)] + ["", "go go go", "unknown words only", train[3]]
    want = brute_kneser_ney(train, texts)[0]
    for name, value in (("FREQUENT", 1), ("PART", 20), ("SHARD_BYTES", 100), ("WORDS", 0), ("BLOOM_MOST", 1 << 12), ("GROUP_BYTES", 1), ("GROUP_TIMES", 0.1)):
        monkeypatch.setattr(quality, name, value)  # words of many trigrams are parted, a filter that lets most through, words joined by a shuffle
    model = quality.fit(spark.createDataFrame([(x,) for x in train], "text string"))
    assert model.lookup.shards > quality.SHARDS
    got = {x.doc_id: x.log10_p for x in quality.score(docs_of(spark, list(enumerate(texts))), model).collect()}
    for i, x in enumerate(want):
        assert got[i] == pytest.approx(x, abs=1e-9, rel=1e-9)


def test_the_model_is_kept_in_buckets_and_read_without_a_shuffle(spark):
    model = quality.fit(spark.createDataFrame([(prose(i, 40),) for i in range(60)], "text string"))
    plan = quality._met(model.more, model.shards, lambda rows: rows, quality._ROW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the other rows', not the trigrams'


def test_numbers_keep_their_value_in_few_bytes():
    for x in ([], [0], [255, 0, 3], [1 << 16, 7], [(1 << 40) + 5, 1]):
        raw = quality._planes(quality.np.array(x, quality.np.int64))
        assert quality._unplaned(raw, len(x)).tolist() == x
    assert len(quality._planes(quality.np.arange(256))) == 256
