"""Onboarding preferences: folding partial patches into one row per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.skew import running_by_key
from kindred.operators.validation import known_active, patch_rules, self_only_rule
from kindred.functions.text import strip
from kindred.schemas import PREFERENCE_FIELDS


def complete(fields: list[str] | None = None) -> Column:
    expr = F.lit(True)
    for f in fields or PREFERENCE_FIELDS:
        expr = expr & F.col(f).isNotNull()
    return expr


def fold(patches: DataFrame, order: tuple[str, str] = ("created_at", "seq")) -> DataFrame:
    """Latest non-null value of every field per user. Map-side combined, one row per user."""
    at = F.struct(*order)
    return (patches.groupBy("user_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in PREFERENCE_FIELDS],
        F.min(order[0]).alias("first_patch_at"), F.max(order[0]).alias("last_patch_at"))
        .withColumn("onboarding_complete", complete()))


def fold_parts(patches: DataFrame, order: tuple[str, str] = ("created_at", "seq")) -> DataFrame:
    """Like :func:`fold` but keeps when each value was set, so that parts can be folded again."""
    return patches.groupBy("user_id").agg(*[
        F.max(F.when(F.col(f).isNotNull(), F.struct(*order, F.col(f).alias("value")))).alias(f)
        for f in PREFERENCE_FIELDS])


def refold(parts: DataFrame) -> DataFrame:
    """Folded parts folded together, in the same shape."""
    return parts.groupBy("user_id").agg(*[F.max(f).alias(f) for f in PREFERENCE_FIELDS])


def merge_parts(parts: DataFrame) -> DataFrame:
    return (refold(parts).select("user_id", *[F.col(f"{f}.value").alias(f) for f in PREFERENCE_FIELDS])
            .withColumn("onboarding_complete", complete()))


def history(patches: DataFrame, **options) -> DataFrame:
    """State right after every patch: each field's latest non-null value and the flag."""
    states = running_by_key(patches, ["user_id"], "created_at", "seq",
                            lasts={f"cur_{f}": F.col(f) for f in PREFERENCE_FIELDS}, **options)
    return states.withColumn(
        "onboarding_complete", complete([f"cur_{f}" for f in PREFERENCE_FIELDS]))


def upsert(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Supplied fields overwrite, the rest is kept; created_at survives, updated_at moves."""
    cur = current.withColumn("_had", F.lit(True)).alias("c")
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = cur.join(new, F.col("c.user_id") == F.col("n.user_id"), "full")
    fields = [F.coalesce(F.col(f"n.{f}"), F.col(f"c.{f}")).alias(f) for f in PREFERENCE_FIELDS]
    return joined.select(
        F.coalesce("c.user_id", "n.user_id").alias("user_id"), *fields,
        F.coalesce("c.created_at", as_of).alias("created_at"),
        F.when(F.col("n._new"), as_of).otherwise(F.col("c.updated_at")).alias("updated_at"),
    ).withColumn("onboarding_complete", complete())


def check_patches(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Patch requests with ``reason``; the location is stripped.

    ``requests``: requester_id, user_id, the seven fields. Order of checks: body, requester, user.
    """
    body = F.coalesce(*patch_rules(), self_only_rule(F.col("requester_id"), F.col("user_id")))
    checked = requests.withColumn("_body", body)
    known = known_active(checked, users)
    return (known.withColumn("reason", F.coalesce("_body", "reason")).drop("_body")
            .withColumn("location", strip(F.col("location"))))


def update(requests: DataFrame, users: DataFrame, current: DataFrame, as_of: Column) -> DataFrame:
    """Preferences after applying every accepted request in order."""
    accepted = check_patches(requests, users).filter(F.col("reason").isNull())
    return upsert(current, fold(accepted), as_of)
