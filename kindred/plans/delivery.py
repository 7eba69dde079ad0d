"""Result delivery: live connections, keyed messages, cache freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.schemas import GROUP_VECTOR_TTL, QUERY_RESULT_TTL, USER_VECTOR_TTL

TTL_SECONDS = {"user": USER_VECTOR_TTL, "group": GROUP_VECTOR_TTL, "query": QUERY_RESULT_TTL}


def live_connections(events: DataFrame) -> DataFrame:
    """(user_id, sid) pairs whose latest event is a connect.

    ``events``: user_id, sid, connected, ts, event_id; rows without a user are refused. The
    registry stays one row per connection, since one user may hold very many.
    """
    return newest_states(events).filter("connected").select("user_id", "sid")


def newest_states(events: DataFrame) -> DataFrame:
    """Newest event per connection, in the shape of the events, so that it can be folded again."""
    newest = (events.filter(F.col("user_id").isNotNull()).groupBy("user_id", "sid")
              .agg(F.max(F.struct("ts", "event_id", "connected")).alias("e")))
    return newest.select("user_id", "sid", "e.connected", "e.ts", "e.event_id")


def connection_counts(live: DataFrame) -> DataFrame:
    return live.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_connections"))


def fan_out(results: DataFrame, live: DataFrame) -> DataFrame:
    """Each result once per live connection of its user; users without one get nothing."""
    return results.join(live, "user_id")


def ttl_of(kind: Column) -> Column:
    seconds = F.lit(None).cast("int")
    for name, ttl in TTL_SECONDS.items():
        seconds = F.when(kind == name, F.lit(ttl)).otherwise(seconds)
    return seconds


def unknown_kinds(cache_events: DataFrame) -> DataFrame:
    """Cache events of a kind that has no lifetime, with ``reason``."""
    known = F.coalesce(F.col("kind").isin(list(TTL_SECONDS)), F.lit(False))
    return cache_events.filter(~known).withColumn("reason", F.lit("unknown kind"))


def newest_entries(cache_events: DataFrame, payload: list[str]) -> DataFrame:
    """Newest event per (kind, key), in the shape of the events, so that parts merge again."""
    at = F.struct("ts", "seq")
    newest = cache_events.groupBy("kind", "key").agg(
        F.max_by(F.struct("op", "ts", "seq", *[c for c in payload if c != "seq"]), at).alias("e"))
    return newest.select("kind", "key", "e.*")


def fresh_entries(cache_events: DataFrame, as_of: Column, payload: list[str]) -> DataFrame:
    """Entries still valid at ``as_of``: newest write per (kind, key), not expired, not removed.

    An entry of a kind without a lifetime never counts as fresh; :func:`unknown_kinds` lists them.

    ``cache_events``: kind, key, op ('set' or 'invalidate'), ts, seq and the payload columns.
    """
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return (newest_entries(cache_events, payload)
            .filter((F.col("op") == "set") & (age < ttl_of(F.col("kind")) * F.lit(1_000_000).cast("long")))
            .select("kind", "key", F.col("ts").alias("cached_at"), *payload))
