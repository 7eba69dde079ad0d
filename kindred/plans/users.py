"""Keeping the users table in step with a stream of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPSERTS = ["user.created", "user.updated"]
DELETE = "user.deleted"
SYNC_COLUMNS = ["email", "first_name", "last_name", "public_metadata"]


def handled(events: DataFrame) -> DataFrame:
    """Events of a known type; others are ignored."""
    return events.filter(F.col("type").isin(*UPSERTS, DELETE) & F.col("user_id").isNotNull())


def fold_events(events: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """One row per user: the payload of its latest upsert, whether the latest event is a delete,
    and both positions, so that folded parts can be folded again. Map-side combined."""
    payload = payload or SYNC_COLUMNS
    at = F.struct("ts", "event_id")
    is_upsert = F.col("type").isin(UPSERTS)
    return handled(events).groupBy("user_id").agg(
        F.max(at).alias("last_at"),
        F.max_by("type", at).alias("last_type"),
        F.max(F.when(is_upsert, at)).alias("upsert_at"),
        F.max_by(F.struct(*payload), F.when(is_upsert, at)).alias("payload"),
    )


def merge_folds(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(
        F.max("last_at").alias("last_at"),
        F.max_by("last_type", "last_at").alias("last_type"),
        F.max("upsert_at").alias("upsert_at"),
        F.max_by("payload", F.when(F.col("upsert_at").isNotNull(), F.col("upsert_at"))).alias("payload"),
    )


def apply_folds(users: DataFrame, folds: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Upsert and soft-delete in one outer join.

    A fold with an upsert overwrites the payload columns (also with null) and creates the user if
    absent; a trailing delete leaves the row inactive; a delete of an unknown user does nothing.
    Columns outside the payload are kept.
    """
    payload = payload or SYNC_COLUMNS
    kept = [c for c in users.columns if c not in {"user_id", "is_active", *payload}]
    u = users.withColumn("_had", F.lit(True)).alias("u")
    joined = u.join(folds.alias("f"), F.col("u.user_id") == F.col("f.user_id"), "full")
    has_upsert = F.col("f.upsert_at").isNotNull()
    return (joined.filter(F.col("u._had") | has_upsert).select(
        F.coalesce("u.user_id", "f.user_id").alias("user_id"),
        *[F.col(f"u.{c}").alias(c) for c in kept],
        *[F.when(has_upsert, F.col(f"f.payload.{c}")).otherwise(F.col(f"u.{c}")).alias(c)
          for c in payload],
        F.when(F.col("f.last_type") == "user.deleted", F.lit(False))
        .when(has_upsert, F.lit(True)).otherwise(F.col("u.is_active")).alias("is_active")))


def sync(users: DataFrame, events: DataFrame, payload: list[str] | None = None) -> DataFrame:
    return apply_folds(users, fold_events(events, payload), payload)


def soft_delete(users: DataFrame, deleted: DataFrame) -> DataFrame:
    ids = deleted.select("user_id").distinct().withColumn("_gone", F.lit(True))
    return (users.join(ids, "user_id", "left")
            .withColumn("is_active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_active")))
            .drop("_gone"))


def cascade_delete(children: DataFrame, deleted: DataFrame, fk: str, key: str) -> DataFrame:
    return children.join(deleted.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def set_shields(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Last accepted threshold per user wins; users without an update keep theirs.

    ``updates``: requester_id, user_id, threshold, ts, seq. Foreign or negative updates are dropped.
    """
    valid = updates.filter((F.col("requester_id") == F.col("user_id")) & (F.col("threshold") >= 0))
    last = valid.groupBy("user_id").agg(F.max_by("threshold", F.struct("ts", "seq")).alias("_new"))
    return (users.join(last, "user_id", "left")
            .withColumn("inbox_shield_threshold", F.coalesce("_new", "inbox_shield_threshold"))
            .drop("_new"))


def add_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Schema upgrade: add missing columns, fill nulls of existing ones, with the defaults."""
    for name, default in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    return df
