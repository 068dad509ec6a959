"""The training-data pipeline: each stage works on all that its predecessor kept, written as Parquet in between.

Nulls: rows with a null id are never taken for copies or for contaminated ones of another id; null and empty texts pass
the stages after the classifier, which judges them like any text without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard, mixing, quality, secrets
from lattica.llm.store import fresh, save

#: A stage's operators fit themselves and decide by hashing, so no SQL gives the rows; tests compare with plain versions.
ORACLE_SQL = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.7)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = fresh("quality_score", docs.columns)
    return quality.score_quality(docs, model, tuple(docs.columns), name).where(F.col(name) >= 0.7).drop(name)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole benchmark window of eight words."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their domain's target weight asks, with the rate."""
    return mixing.sample_mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [("quality classifier", classify), ("n-gram jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("secret scans", redact), ("mixing to target weights", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, "stage")
    return docs
