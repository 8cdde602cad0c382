"""From raw documents to packed sequences, in five stages that are written and read in between.

Each stage takes all rows that its predecessor kept and, but for the last, returns the columns
of `documents`. `run` writes each stage's rows to the session's shared folder; a lost executor
costs the stage at work only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.llm import mixing, packing, pii, quality_rules, simhash
from gantry.llm.common import reachable, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    return quality_rules.keep_good(docs, table(reachable(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose SimHash fingerprints (four words, four bits) hang together the least id stays."""
    reachable(spark)
    return simhash.keep_one(docs, t=4, shingle=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become the name of their kind; n_chars follows the text."""
    reachable(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    reachable(spark)
    return mixing.remix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their places in sequences of 2048 tokens."""
    reachable(spark)
    return packing.best_fit(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can express neither the fingerprints nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
