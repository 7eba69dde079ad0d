"""The registered queries of the numbered operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import (
    audit, bpe, conversations, cosine, decontaminate, licenses, lm, neighbours, quality, repeats, secrets, simhash, toxicity)
from kindred.llm.common import share, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.removed(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _held_out(modulus: int):
    return share(F.col("doc_id"), modulus) == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out(4)))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(4).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = quality.learn_vectors(docs)
    network = quality.train(docs, labels.where(~_held_out(4)), vectors)
    return quality.score(docs, vectors, network).select(
        "doc_id", _held_out(4).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), ~_held_out(7))
    return found.select("doc_id", _held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                        "score", "bits_per_byte")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_cosine_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_secret_scan, op3_byte_bpe, op4_repeats, op5_simhash, op6_toxicity,
        op7_quality, op8_context_tree, op9_nearest, op10_license_scan, op11_cosine_duplicates, op12_repair_conversations,
        op13_filter_audit)
}
ORACLE_SQL: dict[str, str] = {"op10_license_scan": licenses.oracle(), "op11_cosine_duplicates": cosine.oracle(),
                              "op13_filter_audit": audit.oracle()}
