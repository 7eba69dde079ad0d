"""Match requests from raw profiles to results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred import hooks
from kindred.functions import matching as M
from kindred.functions.text import embedding_text, normalize_tags, strip
from kindred.operators.validation import bio_rule, split, tag_count_rule
from kindred.plans import delivery, matching
from kindred.schemas import VECTOR_DIM
from kindred.session import settle


def prepare(profiles: DataFrame, clean_fn: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid profiles, cleaned, with ``embedding_text``; rejected profiles with ``reason``)."""
    valid, rejected = split(profiles, [bio_rule(F.col("bio")), tag_count_rule(F.col("interest_tags"))])
    stripped = (valid.withColumn("bio", strip(F.col("bio")))
                .withColumn("interest_tags", normalize_tags(F.col("interest_tags"))))
    cleaned = hooks.clean_profiles(stripped, clean_fn).withColumn(
        "embedding_text", embedding_text(F.col("sanitized_bio"), F.col("enriched_tags")))
    return cleaned, rejected


def match_profiles(
    profiles: DataFrame,
    communities: DataFrame,
    index: DataFrame,
    activity: DataFrame,
    members: DataFrame,
    users: DataFrame,
    as_of: Column,
    clean_fn: Callable | None = None,
    embed_fn: Callable | None = None,
    intro_fn: Callable | None = None,
    dim: int = VECTOR_DIM,
    cache: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(match results, rejected profiles) for a table of raw profiles.

    ``profiles``: user_id, bio, interest_tags, city, timezone, and request_id where requests have one.
    The hooks run once per valid profile (introductions: once per new soulmate); block sizes come from
    the raw table, so no model runs just to count rows. A result carries its request's id,
    ``created_at`` (= ``as_of``) and, for new soulmates, the introduction. The results are settled:
    the introductions read them twice, and no model may run again. ``cache`` holds vector cache events
    (see :func:`user_vectors`): users with a fresh vector are not embedded again.
    """
    cleaned, rejected = prepare(profiles, clean_fn)
    ids = [c for c in ("request_id", "user_id") if c in profiles.columns]
    vectors = user_vectors(
        cleaned.select(*ids, "city", "timezone", "sanitized_bio", "embedding_text"), as_of, embed_fn, dim, cache)
    results = settle(matching.match_results(
        vectors, communities, index, activity, members, as_of,
        keep=[*ids, "sanitized_bio"], population=profiles, dim=dim), "results")
    new = introductions(
        results.filter(F.col("ai_intro_generated")), communities, activity, members, users, as_of, intro_fn)
    extra = {"intro_text": "string", "mentioned_member": "string", "toxicity_score": "double"}
    rest = results.filter(~F.col("ai_intro_generated")).withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    columns = [c for c in results.columns if c != "sanitized_bio"] + [*extra]
    posted = new.withColumn("ai_intro_generated", F.col("posted"))
    out = posted.select(*columns).unionByName(rest.select(*columns)).withColumn("created_at", as_of)
    return out, rejected


def user_vectors(
    cleaned: DataFrame, as_of: Column, embed_fn: Callable | None = None, dim: int = VECTOR_DIM,
    cache: DataFrame | None = None,
) -> DataFrame:
    """``cleaned`` with ``vector``: from the cache where its newest entry is fresh, else embedded.

    ``cache``: kind, key (the user), op, ts, seq, vector. Only users without a fresh entry reach the
    model.
    """
    if cache is None:
        return hooks.embed(cleaned, batch_fn=embed_fn, dim=dim)
    fresh = delivery.fresh_entries(cache.filter(F.col("kind") == "user"), as_of, ["vector"]).select(
        F.col("key").alias("_key"), F.col("vector").cast("array<float>").alias("vector"))
    same = cleaned["user_id"].cast("string") == fresh["_key"]
    stale = hooks.embed(cleaned.join(fresh, same, "left_anti"), batch_fn=embed_fn, dim=dim)
    return cleaned.join(fresh, same).drop("_key").unionByName(stale)


def cache_writes(vectors: DataFrame, as_of: Column, seq: Column) -> DataFrame:
    """The cache events that store the users' vectors as of now; ``seq`` orders events of one moment."""
    return vectors.select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("key"),
                          F.lit("set").alias("op"), as_of.alias("ts"), seq.alias("seq"), "vector")


def introductions(
    joining: DataFrame, communities: DataFrame, activity: DataFrame, members: DataFrame, users: DataFrame,
    as_of: Column, intro_fn: Callable | None = None,
) -> DataFrame:
    """The introduction of every newly joining soulmate, and whether its toxicity lets it be ``posted``.

    ``joining``: user_id and auto_joined_community. The hook sees the row, the community and its most
    active members, the first of whom it should mention; the default text mentions nobody. Only the
    joined communities' members are ranked. ``fits`` tells whether the text keeps its length limit; it
    does not hold the text back.
    """
    joined = joining.select(F.col("auto_joined_community").alias("community_id")).distinct()
    names = (matching.active_members(
                 users, members.join(joined, "community_id", "left_semi"),
                 activity.join(joined, "community_id", "left_semi"), as_of)
             .groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("rn", "username"))).alias("_m"))
             .select(F.col("community_id").alias("auto_joined_community"),
                     F.transform("_m", lambda m: m["username"]).alias("active_members")))
    details = communities.select(
        F.col("community_id").alias("auto_joined_community"), "community_name", "description")
    asked = (joining.join(details, "auto_joined_community", "left").join(names, "auto_joined_community", "left")
             .withColumn("description", F.coalesce("description", F.lit(""))))
    return hooks.introduce(asked, intro_fn).withColumn("posted", M.postable(F.col("toxicity_score")))
