"""A corpus pipeline: documents to a deduplicated, decontaminated mixture in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import shared, table, workers_find_package
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.exact_dedup import drop_exact_duplicates
from tessera.llm.jaccard_join import drop_near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.quality import quality_scores


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``."""
    workers_find_package(spark)
    return quality_scores(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same text but for white space."""
    workers_find_package(spark)
    return drop_exact_duplicates(docs)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join: five words, a similarity of 0.8 or more."""
    workers_find_package(spark)
    return drop_near_duplicates(docs, size=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in a mixture of their sources."""
    return mix(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_shingles),
    ("benchmark decontamination", no_benchmark),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier can't be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None
