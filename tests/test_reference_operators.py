"""Hand-computed cases of the operators, and every SQL-checked query against its oracle on the smallest tables."""

import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import citations, conversation, evaluation, retrieval, shaping

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_rank_fusion_puts_the_shared_chunk_first(spark):
    leg = lambda *keys: spark.createDataFrame([("q", k, i, 1.0) for i, k in enumerate(keys)], "query_id string, key string, rank int, score double")
    got = retrieval.fuse([leg("c1", "c2"), leg("c2", "c3")], "key").orderBy("rank").collect()
    assert [r.key for r in got] == ["c2", "c1", "c3"]
    assert math.isclose(got[0].score, 1 / 62 + 1 / 61)


def test_no_sparse_hit_keeps_cosine_scores(spark):
    dense = spark.createDataFrame([("q", "a", 0, 0.9), ("q", "b", 1, 0.8)], "query_id string, key string, rank int, score double")
    got = retrieval.fuse_or_dense(dense, dense.where("false"), "key").orderBy("rank").collect()
    assert [(r.key, r.score) for r in got] == [("a", 0.9), ("b", 0.8)]


@pytest.mark.parametrize(("n", "want"), [(6, [1, 3, 5, 6, 4, 2]), (2, [1, 2]), (3, [1, 3, 2])])
def test_sandwich(spark, n, want):
    hits = spark.createDataFrame([("q", i + 1, i) for i in range(n)], "query_id string, chunk_id int, rank int")
    assert [r.chunk_id for r in retrieval.sandwich(hits).orderBy("place").collect()] == want


def test_ndcg_and_mrr_by_hand(spark):
    hits = spark.createDataFrame([("q", "x", 0, 0), ("q", "a", 1, 2), ("q", "a", 2, 2), ("q", "b", 3, 1)], "query_id string, source string, rank int, relevance int")
    expected = spark.createDataFrame([("q", "a", 2), ("q", "b", 2)], "query_id string, source string, best int")
    r = evaluation.retrieval_metrics(hits, expected).first()
    assert r.mrr == 0.5 and r.recall == 1.0
    assert math.isclose(r.ndcg, (2 / math.log2(3) + 1 / math.log2(5)) / (2 + 2 / math.log2(3)))


@pytest.mark.parametrize(("b", "c", "p"), [(5, 1, 14 / 64), (0, 0, 1.0), (3, 3, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert math.isclose(one(spark, evaluation.mcnemar(F.col("b"), F.col("c")), b=b, c=c), p)


def test_kappa_of_equal_raters_is_one(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (1, 1, 1)], "g int, a int, b int")
    assert evaluation.kappa(rows, "a", "b", ["g"]).first().kappa == 1.0
    assert evaluation.kappa(rows.where("false"), "a", "b", ["g"]).count() == 0


def test_bootstrap_holds_its_mean(spark):
    rows = spark.createDataFrame([("g", f"q{i}", float(i % 3)) for i in range(30)], "g string, id string, v double")
    r = evaluation.bootstrap(rows, ["g"], "v", samples=100).first()
    assert r.low <= r.mean <= r.high and r.mean == 1.0


def test_number_lists(spark):
    got = one(spark, citations.numbers(F.col("m")), m="1, 3-5, 9-2, x, 1-200, 7")
    assert got == [1, 3, 4, 5, 7]


def test_spans_and_realignment(spark):
    sources = [(1, 1, "alpha beta gamma delta words here"), (1, 1, "alpha beta"), (2, 3, "quite other epsilon zeta matters follow now")]
    text = "Quite other epsilon zeta matters [Source 1] and more [Source 2][Source 9] end."
    a = spark.createDataFrame([("a", text, sources)], "answer_id string, text string, sources array<struct<doc_id:int,page:int,text:string>>")
    rows = citations.spans(a)
    assert [(r.span, r.ids) for r in rows.orderBy("span").collect()] == [(0, [1]), (1, [1]), (2, [])]
    moved = {r.span: r.ids for r in citations.realigned(rows, a).collect()}
    assert moved[0] == [3]


def test_entity_merge_takes_slots_then_own_list(spark):
    rows = [("q", 0, i, f"m{i}", "d") for i in range(8)] + [("q", 1, i, f"a{i}", "x") for i in range(3)] + [("q", 2, i, f"b{i}", "y") for i in range(1)]
    df = spark.createDataFrame(rows, "query_id string, entity int, rank int, key string, doc_id string")
    got = [r.key for r in retrieval.merge_entities(df).orderBy("rank").collect()]
    assert got == ["a0", "a1", "b0", "m0", "m1", "m2", "m3", "a2"]




@pytest.mark.parametrize(("q", "want"), [("list docs about x", "compound"), ("List documents", "library"), ("what is x", "rag")])
def test_intent(spark, q, want):
    assert one(spark, conversation.intent(F.col("q")), q=q).intent == want


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.tokenise, "See <b>ACS-880</b> v1.2 *x*", ["see", "acs-880", "acs", "880", "v1.2", "v1", "2", "x"]), (X.clean_url, "https://a.b/c?x-sign=1&v=2", "https://a.b/c?v=2"), (X.clean_url, "pre-log", ""),
        (X.canonical_unc, "\\\\?\\UNC\\Host\\Share\\A", "\\\\host\\share\\a"), (X.canonical_unc, "C:\\x", None), (X.sid_to_principal, "S-1-1-0", "*"), (X.normalised_folder, " a \\ b//c ", "a/b/c"), (X.normalised_folder, "a/../b", None),
        (X.expanded_ids, "A02–A04, B01", ["A02", "A03", "A04", "B01"]), (X.host_of, "https://u:p@Ex.com:80/x", "ex.com:80"), (X.unfenced, "```json\n{}\n```", "{}"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, f(F.col("c")), c=given) == want


def test_entry_point_has_queries_without_the_subpackage():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.plans.QUERIES) > 130


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
