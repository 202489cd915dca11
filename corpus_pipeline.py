"""A corpus pipeline of five stages, each an operator of ``quarrywell.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next.  All but the last return the columns of documents.

Defined results: null and empty texts have too few words and go in the first stage; columns other than text stay as they
are, nulls too; of equal rows all stay or go together, except that a row without an id goes where its group has one;
rows of one id are told apart by their texts; an empty table gives no pieces; without labels the base rules alone judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrywell.llm import op1_secrets, op6_minhash_forest, op7_packing, op8_repeated_units, op9_quality_rules
from quarrywell.llm.common import dropped, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return op9_quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their shingles of five words): that of the smallest id."""
    return op6_minhash_forest.one_of_each(docs, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that an earlier document keeps."""
    return op8_repeated_units.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return op1_secrets.redacted(docs, op1_secrets.train(op1_secrets.training_samples(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return op7_packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Signatures, trained rules and tokens have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = written(out, f"pipeline-{name}")
        dropped(out)
    return docs
