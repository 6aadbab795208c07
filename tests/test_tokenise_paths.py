"""Tokens with and without parts, and that a line without a token of parts takes the path that doesn't look at each of its tokens."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X

CASES = {"Plain words. End": ["plain", "words", "end"], "a-b c": ["a-b", "a", "b", "c"], "v1.2/x": ["v1.2/x", "v1", "2", "x"], "a--b": ["a--b", "a", "b"], "- x -": ["x"], "": [], None: None, "<b>A*b": ["a", "b"]}


@pytest.mark.parametrize("line", list(CASES))
def test_tokens(spark, line):
    assert spark.createDataFrame([(line,)], "t string").select(X.tokenise(F.col("t"))).first()[0] == CASES[line]


def test_plain_lines_have_a_path_of_their_own(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(X.tokenise(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE(translate" in plan
