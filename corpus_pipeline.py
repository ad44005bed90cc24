"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again, so a lost executor costs no earlier stage. What a stage wrote for itself is deleted once its
result is written, and that result once the next one's is. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsift.llm.common import delete_folder, scratch, shared_folder
from pairsift.llm.decontaminate import decontaminate_stage
from pairsift.llm.language import language_stage
from pairsift.llm.mixing import mix_sources
from pairsift.llm.neardup import near_duplicate_stage
from pairsift.llm.quality import quality_stage


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents replicated to the target weights, in shuffled order, with their copy number."""
    return mix_sources(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mixing_stage),
]

#: Trained classifiers and SimHash have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        folder = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return docs
