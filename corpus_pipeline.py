"""The corpus pipeline: from raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tristrata.llm import decontaminate, exact_dedup, language, packing, similar
from tristrata.llm.queries import TOKENIZER
from tristrata.llm.registry import table
from tristrata.session import new_work_path, tune

#: Least calibrated score of a language; below it, and without letters, a document is rejected.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return language.keep_identified(docs, language.train(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest id.

    SimHash fingerprints within four bits pair texts, whose similarity is then checked; MinHash finds similar texts
    whose fingerprints differ in more.
    """
    return similar.drop_similar(docs, similarity=0.8, shingle=5, radius=4)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, TOKENIZER, capacity=1024, end_id=0)


STAGES = [
    ("language ID", identify_language), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_passages), ("packing", pack),
]

#: Trained models, fingerprints, alignments and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    spark = tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_work_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
