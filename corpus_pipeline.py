"""From raw documents to sharded training text: the stages, in order.

Each stage takes what its predecessor kept, whole, and returns it with the
columns of ``documents``; the last one returns where each row goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import cube, decontaminate, ngram_join, quality, sharding
from retentio.llm.tables import importable, read, saved


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (five words, 0.8): the one of the smallest id."""
    importable(spark)
    return ngram_join.one_of_each(docs, shingle=5, percent=80)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    importable(spark)
    return cube.repeated(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot, copies of a text together."""
    importable(spark)
    return sharding.shard(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality", good_documents),
    ("near_copies", unlike_documents),
    ("benchmark", clean_documents),
    ("mix", mixed_documents),
    ("shards", sharded_documents),
]

#: A classifier fitted on labels and an iterative join are beyond SQL; a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
