"""The stream jobs and the readers of what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.plans import delivery, matching, preferences, users
from kindred.schemas import PREFERENCE_FIELDS
from kindred.sources import messages
from kindred.streaming import keyed, sinks

# --- match results ------------------------------------------------------------------------------


def match_stream(
    profiles: DataFrame, path: str, checkpoint: str,
    candidates: DataFrame, popular: DataFrame, index: DataFrame, members: DataFrame, **options,
) -> StreamingQuery:
    """Profile rows with vectors in, one match result per profile out.

    ``candidates`` and ``popular`` are recomputed by every batch if they are plans, and only read
    if they are settled tables. Blocks are sized by the batch, not by the users table.
    """
    def matched(batch: DataFrame) -> DataFrame:
        return matching.match_against(batch, candidates, popular, index, members, **options)

    return sinks.per_batch(profiles, path, checkpoint, matched)


# --- points -------------------------------------------------------------------------------------

SCORES = "user_id long, karma_score long, batch long"


def score_stream(ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running score per user; every batch writes the users whose score moved."""
    totals = ledger.groupBy("user_id").agg(F.sum("point_delta").cast("long").alias("karma_score"))
    return sinks.per_batch(totals, path, checkpoint, mode="update")


def current_scores(spark: SparkSession, path: str, schema: str = SCORES) -> DataFrame:
    return sinks.latest_by_batch(sinks.read(spark, path, schema), ["user_id"], ["karma_score"])


# --- users and preferences ----------------------------------------------------------------------

def user_sync_stream(events: DataFrame, path: str, checkpoint: str, payload: list[str] | None = None) -> StreamingQuery:
    """Change events in; one row per user that a micro-batch changes is appended under ``path``, and the
    current row of every user stays in the state (:func:`synced_users`)."""
    return sinks.append(keyed.users(events, payload), path, checkpoint)


def synced_users(base: DataFrame, checkpoint: str, payload: list[str] | None = None) -> DataFrame:
    """The stored users with the state of the stream laid over them."""
    payload = payload or users.SYNC_COLUMNS
    current = sinks.state(base.sparkSession, checkpoint, schema=keyed.user_schema(payload))
    folds = current.select(
        "user_id", F.when(F.col("deleted"), users.DELETE).alias("last_type"), F.col("upsert_ts").alias("upsert_at"),
        F.struct(*payload).alias("payload"))
    return users.apply_folds(base, folds, payload)


def preference_stream(
    requests: DataFrame, path: str, checkpoint: str, known: DataFrame, stored: DataFrame | None = None,
    as_of: Column | None = None,
) -> StreamingQuery:
    """Patch requests in; the current row of every user that a micro-batch patches out.

    Requests pass the same checks as in a batch (requester, active user of ``known``, choices, location); refused
    ones are left out. ``stored`` are the rows from before the stream, ``as_of`` the time patches count as applied
    (default: when their batch runs).
    """
    checked = preferences.check_patches(requests, known).filter(F.col("reason").isNull())
    touched = checked.withColumn("touched", F.current_timestamp() if as_of is None else as_of)
    return sinks.append(keyed.preferences(touched, stored), path, checkpoint)


def current_preferences(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every user's row, in the columns of the stored table."""
    schema = keyed.preference_schema()
    state = sinks.state(spark, checkpoint, schema=schema)
    times = [F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    return state.select("user_id", *PREFERENCE_FIELDS, *times).withColumn("onboarding_complete", preferences.complete())


# --- cache freshness ----------------------------------------------------------------------------

def cache_stream(
    events: DataFrame, path: str, checkpoint: str, payload: list[str], lifetimes: dict[str, int] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Follow cache writes and removals (kind, key, op, ts, seq and the payload columns).

    The state holds each entry's newest event and lets go of it when its kind's lifetime (milliseconds) has passed since
    it was written there; the newest event by ``ts`` wins, whatever order they come in. Lifetimes pass by the clock, so
    a stream that stops once all input is read would never stop: the default takes what there is as one batch, a
    standing job gives a ``processingTime`` trigger.
    """
    lives = lifetimes or {kind: 1000 * seconds for kind, seconds in delivery.TTL_SECONDS.items()}
    return sinks.append(keyed.entries(events, lives, payload), path, checkpoint, trigger or {"once": True})


def live_entries(
    spark: SparkSession, checkpoint: str, as_of: Column, payload: str, kinds: list[str] | None = None,
) -> DataFrame:
    """The entries of the state that are still fresh at ``as_of`` by the time they were written with.

    ``payload``: the payload columns' DDL; ``kinds``: those the stream was given lifetimes of.
    """
    schema = f"key string, live boolean, at long, seq long, {payload}"
    columns = [c.split()[0] for c in payload.split(", ")]
    parts = [sinks.state(spark, checkpoint, kind, f"kind string, {schema}") for kind in kinds or delivery.TTL_SECONDS]
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    age = F.unix_micros(as_of.cast("timestamp")) - F.col("at")
    return (held.filter(F.col("live") & (age < delivery.ttl_of(F.col("kind")) * F.lit(1_000_000).cast("long")))
            .select("kind", "key", F.timestamp_micros("at").cast("timestamp_ntz").alias("cached_at"), "seq", *columns))


# --- presence and delivery ----------------------------------------------------------------------

def presence_stream(
    connections: DataFrame, path: str, checkpoint: str, delay: str = "1 day", silence_ms: int = 7 * 86_400_000,
) -> StreamingQuery:
    """Connects and disconnects in (user_id, sid, connected, ts, event_id), each change of a connection out.

    The state holds a user's open connections: closed ones and those without a sign of life leave it.
    """
    return sinks.append(keyed.connections(connections, delay, silence_ms), path, checkpoint)


def present(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, sid) of the open connections; a user without any has no row."""
    state = sinks.state(spark, checkpoint, "connections", f"user_id long, share long, sid string, {keyed.CONNECTION}")
    return state.filter("connected").select("user_id", "sid")


def delivery_stream(
    results: DataFrame, signs: DataFrame, path: str, checkpoint: str, reach: str = "1 day", delay: str = "1 hour",
) -> StreamingQuery:
    """Each published result once per connection that its user has open when it is published.

    A join of two streams: a result (event_id, user_id, ts, ...) meets the signs of life (user_id, sid, connected, ts,
    event_id) of its user in the ``reach`` before it; it goes to a connection whose newest sign by then is a connect. So a
    result from before its user connects is not delivered, nor one to a connection closed or silent for ``reach``. Rows
    of both streams may come up to ``delay`` late; state older than that and ``reach`` is dropped.
    """
    columns = [c for c in results.columns if c not in ("event_id", "user_id", "ts")]
    sent = results.withColumn("sent_at", F.col("ts").cast("timestamp")).drop("ts").withWatermark("sent_at", delay)
    seen = signs.select(F.col("user_id").alias("_user"), "sid", "connected", F.col("event_id").alias("_event"),
                        F.col("ts").cast("timestamp").alias("seen_at")).withWatermark("seen_at", delay)
    # A sign lies in the stretch of time of the result or in the one before: rows of a user meet within stretches only.
    length = results.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {reach})").first()[0]
    stretch = F.floor(F.unix_micros("sent_at") / length)
    sent = sent.withColumn("_stretch", F.explode(F.array(stretch, stretch - 1)))
    seen = seen.withColumn("_seen_in", F.floor(F.unix_micros("seen_at") / length))
    met = sent.join(seen, (F.col("user_id") == F.col("_user")) & (F.col("_stretch") == F.col("_seen_in"))
                    & (F.col("seen_at") <= F.col("sent_at"))
                    & (F.col("seen_at") >= F.col("sent_at") - F.expr(f"INTERVAL {reach}")))
    # One event-time column goes on: a result is decided once the watermark has passed it.
    place = F.struct(F.unix_micros("seen_at").alias("at"), F.col("_event").alias("event"))
    told = met.select("event_id", "user_id", "sent_at", *columns, "sid", "connected", place.alias("place")).groupBy(
        "event_id", "user_id", "sent_at", *columns, "sid").agg(F.max_by("connected", "place").alias("open"))
    return sinks.append(told.filter("open").drop("open"), path, checkpoint)


def publish_stream(results: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Results in, keyed messages out: appended by the file sink, one folder per day of sending."""
    keyed_rows = messages.keyed_messages(results, columns).withColumn("sent_on", F.to_date(F.current_timestamp()))
    return sinks.append(keyed_rows, path, checkpoint, partition_by=["sent_on"])


def subscribe_stream(spark: SparkSession, path: str, schema: str, trigger_files: int | None = None) -> DataFrame:
    """The published messages as a stream, parsed like :func:`messages.parse_results`: other channels and malformed
    messages are left out, each message comes once over any restart of the reader."""
    source = spark.readStream.schema("key string, value string, sent_on date")
    if trigger_files:
        source = source.option("maxFilesPerTrigger", trigger_files)
    return messages.parse_results(source.parquet(path).select("key", "value"), schema)


# --- activity -----------------------------------------------------------------------------------

DAILY = "community_id long, day date, late boolean, n long, batch long"
LATE = "message_id long, community_id long, created_at timestamp_ntz, batch long"


def daily_activity_stream(activity: DataFrame, path: str, checkpoint: str, delay_days: int = 2) -> StreamingQuery:
    """Messages per community and day, as increments: one partition of counts per micro-batch.

    A row is late if its day ends before the newest time of all earlier batches less ``delay_days``. Late rows are kept:
    they lie in a table of their own (``late``, see :func:`late_rows`) and their counts are marked, so a reader takes
    the days as they were closed, or corrected (:func:`daily_counts`). The stream keeps no state: what it
    knows of earlier batches is their newest time, one row each. A batch that runs again overwrites its partitions.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = sinks.read(spark, f"{path}/marks", "newest timestamp_ntz, batch long")
        newest = marks.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        day = F.to_date("created_at")
        closed = F.lit(False) if newest is None else day < F.date_sub(F.to_date(F.lit(newest)), delay_days)
        rows = batch.withColumn("day", day).withColumn("late", F.coalesce(closed, F.lit(False)))
        counts = rows.groupBy("community_id", "day", "late").agg(F.count(F.lit(1)).alias("n"))
        sinks.overwrite_batch(counts, f"{path}/counts", batch_id)
        if newest is not None:
            sinks.overwrite_batch(rows.filter("late").select("message_id", "community_id", "created_at"), f"{path}/late", batch_id)
        sinks.overwrite_batch(batch.agg(F.max("created_at").cast("timestamp_ntz").alias("newest")), f"{path}/marks", batch_id)

    return (activity.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**sinks.ALL_THERE_IS).start())


def late_rows(spark: SparkSession, path: str, schema: str = LATE) -> DataFrame:
    return sinks.read(spark, f"{path}/late", schema)


def daily_counts(spark: SparkSession, path: str, corrected: bool = True) -> DataFrame:
    """``community_id``, ``day``, ``n``: with the late rows merged in, or as the days were closed."""
    parts = sinks.read(spark, f"{path}/counts", DAILY)
    return (parts if corrected else parts.filter("NOT late")).groupBy("community_id", "day").agg(F.sum("n").alias("n"))


def trailing_counts(daily: DataFrame, days: int = 7) -> DataFrame:
    """Messages of the ``days`` days ending with each day, from daily counts.

    A day's count is added to the days it belongs to: one row per community and day is kept instead of one per
    overlapping window.
    """
    spread = daily.withColumn("day", F.explode(F.sequence("day", F.date_add("day", days - 1))))
    return spread.groupBy("community_id", "day").agg(F.sum("n").alias("message_count"))
