"""Model hooks with their defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred import hooks
from kindred.catalog.base import query
from kindred.catalog.composites import decided
from kindred.catalog.scalars import BIO_SQL, ENRICHED_SQL, MASKED_SQL, TAGS_SQL, TOKEN_BREAK_SQL, bios
from kindred.functions import text as X
from kindred.functions.matching import postable


@query("v01_text_vectors", f"""
    SELECT user_id, CAST({hooks.VECTOR_DIM} AS INTEGER) AS dims, count(slot) AS n_slots,
           round(CAST(CAST(coalesce(max(n) / sqrt(sum(n * n)), 0) AS FLOAT) AS DOUBLE), 5) AS largest,
           coalesce(arg_max(slot, [n, -slot]), 0) AS largest_slot
    FROM (SELECT user_id, slot, CAST(count(slot) AS DOUBLE) AS n FROM (
            SELECT user_id, CASE WHEN token <> '' THEN CAST('0x' || substr(md5(token), 1, 7) AS INTEGER) % {hooks.VECTOR_DIM} END AS slot
            FROM (SELECT user_id, unnest(string_split_regex(lower('Bio: ' || bio || chr(10) || 'Interests: ' || array_to_string({TAGS_SQL}, ', ')), '{TOKEN_BREAK_SQL}')) AS token FROM profiles))
          GROUP BY 1, 2) GROUP BY 1""")
def v01(v):
    """Hashed-token vector of every text: its size, used slots, largest weight and where it is."""
    texts = v.profiles.select("user_id", X.embedding_text(
        F.col("bio"), X.normalize_tags(F.col("interest_tags"))).alias("embedding_text"))
    vectors = hooks.embed(texts).select("user_id", "vector")
    return vectors.select(
        "user_id", F.size("vector").alias("dims"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("n_slots"),
        F.round(F.array_max("vector").cast("double"), 5).alias("largest"),
        (F.array_position("vector", F.array_max("vector")) - 1).cast("int").alias("largest_slot"))


@query("v02_clean_profiles", f"""
    SELECT user_id, {MASKED_SQL} AS sanitized_bio, array_to_string({ENRICHED_SQL}, ',') AS enriched_tags,
           {MASKED_SQL} <> {BIO_SQL} AS pii_removed FROM profiles""")
def v02(v):
    p = bios(v).withColumn("interest_tags", X.normalize_tags(F.col("interest_tags")))
    return hooks.clean_profiles(p).select(
        "user_id", "sanitized_bio", F.array_join("enriched_tags", ",").alias("enriched_tags"), "pii_removed")


@query("v03_introductions", """
    SELECT t.user_id, c.community_id, 'Welcome to ' || c.community_name || '! We''re excited to have you here.' AS intro_text,
           CAST(NULL AS VARCHAR) AS mentioned_member, CAST(0 AS DOUBLE) AS toxicity_score, FALSE AS model_failed, TRUE AS fits
    FROM tiers t JOIN communities c ON c.community_id = t.auto_joined_community""")
def v03(v):
    soulmates = decided(v).filter(F.col("tier") == "soulmate").select(
        "user_id", F.col("auto_joined_community").alias("community_id"),
        F.col("matches")[0]["community_name"].alias("community_name"))
    return hooks.introduce(soulmates).drop("community_name")


@query("v04_toxicity", """
    SELECT d.doc_id, coalesce(x.score, 0) AS toxicity_score, coalesce(x.score, 0) < 0.75 AS postable, FALSE AS model_failed
    FROM documents d LEFT JOIN toxicity x ON x.user_id = d.doc_id""")
def v04(v):
    labels = v.toxicity.withColumnRenamed("user_id", "doc_id")
    scored = hooks.score_toxicity(v.table("documents").select("doc_id"), labels=labels)
    return scored.withColumn("postable", postable(F.col("toxicity_score")))
