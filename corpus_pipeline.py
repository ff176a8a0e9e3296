"""The training-data pipeline over ``documents``.

Quality rules reject documents, the Jaccard join keeps one document of each group, personal data is replaced in the texts,
sources are mixed to their target weights (documents are repeated and ordered by training position), and the result is
packed into sequences. Each stage is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.best_fit_packing import pack_documents
from lodestone.llm.chosen_path import keep_representatives
from lodestone.llm.common import table, written
from lodestone.llm.curriculum_mix import mix_documents
from lodestone.llm.pii_sanitiser import sanitise
from lodestone.llm.quality_rules import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new texts."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("pii", pii),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Hash orders, min-hashes and tokenisers are not SQL; tests/llm compares the rows of the join's stage with brute force and
#: checks the decisions of the others, without a brute-force run of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
