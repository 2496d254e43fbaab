"""The corpus pipeline: each stage applies one operator to the documents its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultlens.llm import mixing, packing, quality, simhash, substrings
from faultlens.llm.common import store, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies stays."""
    return simhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts."""
    return substrings.without_repeated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents as token ids, with their places in sequences."""
    return packing.pack_documents(docs, ids=False)


STAGES = [("quality_classifier", good), ("simhash_dedup", distinct), ("substring_dedup", unrepeated), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: Trained scores, fingerprint links and searched packings have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the given documents; every stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
