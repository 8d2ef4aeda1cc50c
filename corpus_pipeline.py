"""A training corpus from raw documents: five stages, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir). Between stages the rows are written as
Parquet and read again, so a lost executor costs one stage at most and no plan
grows; a stage's folder is deleted once its successor is written. All stages but the last return the columns of ``documents``, whatever other
columns there are.

Defined cases: a null, empty or blank text has no words and goes with the quality
rules; given to a later stage alone, such texts are one class for exact dedup, are
linked with nothing in the Jaccard join, stay as they are in the secret scan, and are
the end id alone when packed. Of ties and repeated rows one stays: the smallest id,
a null id last, then the first place. Empty tables give empty results. Very long
texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.llm import exact_dedup, jaccard, packing, quality, secrets
from speechmill.llm.queries import tokenizer
from speechmill.sources.shared import checkpoint_dir, delete


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar sets of five-word shingles stays."""
    return jaccard.representatives(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in a training sequence."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("packing", sequences),
]

#: Token ids and a trained network: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
