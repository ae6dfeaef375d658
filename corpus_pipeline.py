"""From raw documents to packed sequences: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchmill.llm import blocknames, hyperminhash, langid, mixing, packing
from matchmill.llm.scratch import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that the network, learned from the labelled part, does not recognise."""
    return langid.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space one stays."""
    return blocknames.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on shingles of five words one stays."""
    return hyperminhash.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes to its target; a text holds as many of its words as the mix takes."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]

#: The stages learn, draw and follow links, which SQL can't express; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
