"""A corpus pipeline of the operators in docspark.llm: language, quality, near copies, benchmark leaks, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the
documents it keeps, with the columns of its input.  The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontamination, language_id, ngram_join, packing, quality_classifier
from docspark.llm.common import find_package, table
from docspark.llm.queries import tokenizer_path
from docspark.sources import shared


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough certainty."""
    find_package(spark)
    return language_id.accepted(docs, language_id.fit(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    find_package(spark)
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences."""
    find_package(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("ngram_join", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages train models and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared.scratch(spark, "corpus")  # goes away with the driver
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            shared.remove(spark, before)
        before = f"{folder}/{name}"
    return docs
