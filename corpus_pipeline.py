"""The corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe, decontaminate, secrets, simhash, toxicity
from kindred.llm.common import share, table
from kindred.session import shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of a model that learned from labelled documents outside the held-out share."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(share(labels["doc_id"], 4) != 2))
    return toxicity.keep_clean(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: three-word shingles, at most 3 differing bits."""
    return simhash.keep_one(docs, size=3, distance=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return bpe.digests(bpe.decode(bpe.encode(docs)))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", remove_secrets),
    ("tokens", tokens),
]

# Neither trained scores nor byte-pair merges can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
