"""Letter vectors are counted in one pass over bytes, as the Column counts them."""

from folioscope.plans import retrieval_queries as Q


def test_letter_vectors(spark):
    texts = ["teatime", "", "ünïté ETA Ñ \U0001f600 oo", "x\ny", "insh" * 700]
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "key string, doc_id long, text string")
    wanted = {r["key"]: r["v"] for r in df.select("key", Q._letters("text").alias("v")).collect()}
    assert {r["key"]: r["vector"] for r in Q._lettered(df).collect()} == wanted
