"""From documents to packed training sequences: five stages, each by an operator of folioscope.llm.

A stage takes all that its predecessor kept; all but the last return the columns of documents. In every stage null and empty texts
are documents without words; whole texts of any length are read; repeated rows are rows of their own, but for the two stages that drop
copies; columns beyond those of documents pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import exact_dedup, jaccard_join, packing, quality, secret_scan
from folioscope.llm.shared import saved, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Texts without words and rows with a null doc_id stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text. Null, empty and blank texts are one group, of which one row stays."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 and more on five-word shingles connect. Texts without words are linked with none; a null doc_id stays."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text. A null text stays null."""
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences. A null or empty text is one piece, of the end id alone."""
    pieces = packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("best_fit_packing", best_fit_packing),
]

#: The quality classifier can't be said in SQL; the pipeline is tested against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = saved(stage(spark, docs, sf_dir), name, beyond=True)
    return STAGES[-1][1](spark, docs, sf_dir)
