"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder and
reads them again for the next.

In every stage a null or empty text, a null in another column, repeated rows, an empty
table and columns of any name have the result that the stage's operator states; all but
the last return the columns that they were given, and none reads a column that is not of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drift_engine import storage
from drift_engine.llm import mixing, near_dedup, packing, quality_model, quality_rules
from drift_engine.llm.common import materialise

#: Jaccard similarity of word shingles, in per cent, from which the stage takes documents as near-duplicates.
NEAR_PERCENT = near_dedup.PERCENT


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is high enough; repeated rows stay or go alike, no rows give none."""
    return quality_model.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their host share; null and empty texts go, no rows give none."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and of repeated rows; documents without words all stay, no rows give none."""
    return near_dedup.first_documents(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their targets: documents stand as often as the mix takes them; texts without a word are never taken, no rows give none."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces in sequences; a null or empty text is the end id alone, no rows give none."""
    return packing.pack(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Tokens, models and component search are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = storage.mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # All that led to these rows is done with, the previous stage's rows too.
        storage.release(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
