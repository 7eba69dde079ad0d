"""Streaming jobs (T01-T08), run over all available input and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.catalog.base import ALL_FIELDS_SQL, AS_OF, DIM, LATEST_FIELDS_SQL, Views, as_of, query
from kindred.catalog.changes import SYNC_SQL, synced_users
from kindred.plans import delivery, matching, preferences
from kindred.schemas import PREFERENCE_FIELDS
from kindred.session import settle, shared_dir
from kindred.sources import messages
from kindred.streaming import jobs, sinks


class StreamViews(Views):
    """The same views over the events table read as a stream."""

    def table(self, name: str) -> DataFrame:
        static = super().table(name)
        if name not in ("events", "customer"):
            return static
        # Braces make the path a glob, which the file source accepts for a file and a folder alike.
        return self.spark.readStream.schema(static.schema).parquet(f"{self.dir}/{{{name}.parquet}}")


_BOTH = ", ".join(f"coalesce(n.{f}, c.{f}) AS {f}" for f in PREFERENCE_FIELDS)


def _run(v, name, start):
    """Start a job under a fresh shared folder and wait for it; its output and its checkpoint."""
    base = shared_dir(v.spark, name)
    start(f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out", f"{base}/checkpoint"


def _streams(v):
    return StreamViews(v.spark, v.dir)


@query("t01_match_stream", "SELECT user_id, tier, auto_joined_community, ai_intro_generated FROM results")
def t01(v):
    requests = _streams(v).table("customer").select(F.col("c_custkey").alias("user_id"))
    candidates = settle(matching.location_candidates(v.communities, v.activity, as_of()), "candidates")
    popular = settle(matching.popular_communities(v.communities, v.activity, as_of()), "popular")
    out, _ = _run(v, "match", lambda p, c: jobs.match_stream(
        requests.join(v.user_vectors, "user_id"), p, c, candidates, popular, v.index, v.members,
        toxicity=v.toxicity, dim=DIM))
    return sinks.read(v.spark, out, "user_id long, tier string, auto_joined_community long, ai_intro_generated boolean")


@query("t02_score_stream", "SELECT user_id, CAST(sum(point_delta) AS BIGINT) AS karma_score FROM ledger GROUP BY 1")
def t02(v):
    out, _ = _run(v, "scores", lambda p, c: jobs.score_stream(_streams(v).ledger, p, c))
    return jobs.current_scores(v.spark, out)


@query("t03_user_sync_stream", SYNC_SQL.format(where="AND event_id % 97 <> 5"))
def t03(v):
    events = messages.parse_change_events(_streams(v).change_messages).withColumn(
        "user_id", F.col("user_id").cast("long"))
    _, checkpoint = _run(v, "users", lambda p, c: jobs.user_sync_stream(events, p, c))
    return jobs.synced_users(synced_users(v), checkpoint)


@query("t04_preference_stream", f"""
    SELECT *, ({ALL_FIELDS_SQL}) AS onboarding_complete FROM (
      SELECT coalesce(c.user_id, n.user_id) AS user_id, {_BOTH}, TIMESTAMP '{AS_OF}' AS created_at,
             CASE WHEN n.user_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE c.updated_at END AS updated_at
      FROM (SELECT user_id, TIMESTAMP '{AS_OF}' AS updated_at, {LATEST_FIELDS_SQL} FROM pref_patches
            WHERE created_at < TIMESTAMP '2024-01-16' GROUP BY 1) c
      FULL JOIN (SELECT user_id, {LATEST_FIELDS_SQL} FROM checked_patches
                 WHERE reason IS NULL AND created_at >= TIMESTAMP '2024-01-16' GROUP BY 1) n ON c.user_id = n.user_id)""")
def t04(v):
    """Requests of the second half of the month as a stream, onto the rows stored before it."""
    late = F.col("created_at") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    stored = preferences.fold(v.pref_patches.filter(~late)).select("user_id", *PREFERENCE_FIELDS).withColumns(
        {"created_at": as_of(), "updated_at": as_of()})
    _, checkpoint = _run(v, "preferences", lambda p, c: jobs.preference_stream(
        _streams(v).patch_requests.filter(late), p, c, settle(v.users, "known"), settle(stored, "stored"), as_of()))
    return jobs.current_preferences(v.spark, checkpoint)


FRESH_SQL = """
    SELECT kind, key, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts DESC, seq DESC) AS rn FROM cache_events)
    WHERE rn = 1 AND op = 'set' AND ts + to_seconds(CASE kind WHEN 'user' THEN 604800 WHEN 'group' THEN 86400 ELSE 900 END)
      > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY"""


def yesterday():
    return as_of() - F.expr("INTERVAL 1 DAY")


@query("t05_fresh_entries", FRESH_SQL)
def t05(v):
    return delivery.fresh_entries(v.cache_events, yesterday(), ["seq"]).select("kind", "key", "seq")


@query("t05_cached_vectors", f"""
    SELECT f.key AS user_id, CAST(len(e.embedding) AS BIGINT) AS dims, CAST(list_sum(e.embedding) AS DOUBLE) IS NOT NULL AS whole,
           CAST(e.embedding[1] AS DOUBLE) AS first_value
    FROM ({FRESH_SQL}) f JOIN embeddings e ON e.vec_id = f.seq % (SELECT count(*) FROM embeddings) WHERE f.kind = 'user'""")
def t05_vectors(v):
    """Vectors as cached payload: the newest write of a user, if it is fresh and not removed."""
    vectors = v.index.select(F.col("community_id").alias("_i"), "vector")
    writes = v.cache_events.filter("kind = 'user'").withColumn("_i", F.col("seq") % v.n_vectors).join(vectors, "_i").drop("_i")
    return delivery.fresh_entries(writes, yesterday(), ["seq", "vector"]).select(
        F.col("key").alias("user_id"), F.size("vector").cast("long").alias("dims"),
        F.forall("vector", lambda x: x.isNotNull()).alias("whole"), F.col("vector")[0].cast("double").alias("first_value"))


@query("t05_cache_stream", FRESH_SQL)
def t05_stream(v):
    _, checkpoint = _run(v, "cache", lambda p, c: jobs.cache_stream(_streams(v).cache_events, p, c, ["value"]))
    return jobs.live_entries(v.spark, checkpoint, yesterday(), "value double").select("kind", "key", "seq")


# The watermark is a day behind the newest event; a connection ends a week after its last sign of life, in whole minutes.
@query("t06_presence_stream", """
    SELECT user_id, sid FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, sid ORDER BY ts DESC, event_id DESC) AS rn FROM connections)
    WHERE rn = 1 AND connected
      AND 60000 * CAST(ceil((epoch_us(ts) / 1000.0 + 7 * 86400000) / 60000.0) AS BIGINT)
          > (SELECT epoch_ms(max(ts)) - 86400000 FROM connections)""")
def t06(v):
    _, checkpoint = _run(v, "presence", lambda p, c: jobs.presence_stream(_streams(v).connections, p, c))
    return jobs.present(v.spark, checkpoint)


def raw_messages(v):
    """Published messages: some on other channels, some cut short."""
    e = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_id").alias("task"), F.col("event_type").alias("tier")))
    key = F.when(e % 5 == 0, F.concat(F.lit("audit_"), "user_id")).otherwise(
        messages.channel(F.col("user_id")))
    return v.events.select("event_id", "ts", key.alias("key"),
                           F.when(e % 13 == 2, F.substring(body, 1, 9)).otherwise(body).alias("value"))


def ended(v, rows, name, at="2030-01-01 00:00:00"):
    """The stream with one more row of a user that no other row names, a long time after the others, as the end of the
    input: the watermark passes every real row. (A row without a user would be dropped before it counts.)"""
    fixed = {"ts": F.lit(at).cast("timestamp_ntz"), "user_id": F.lit(name)}
    path = shared_dir(v.spark, "end")
    v.spark.range(1).select(*[fixed.get(c, F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes]).write.parquet(path)
    return rows.unionByName(v.spark.readStream.schema(rows.schema).parquet(path))


@query("t07_result_fan_out", """
    SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS user_id, c.sid, e.event_type AS tier
    FROM events e JOIN connections c ON c.user_id = e.user_id AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 1 DAY
    WHERE e.event_id % 5 <> 0 AND e.event_id % 13 <> 2
    GROUP BY e.event_id, e.user_id, c.sid, e.event_type HAVING arg_max(c.connected, (c.ts, c.event_id))""")
def t07(v):
    """Published messages and connection events as two streams."""
    s = _streams(v)
    results = messages.parse_results(raw_messages(s), "task long, tier string").select(
        "event_id", "user_id", "ts", "result.tier")
    signs = s.connections.withColumn("user_id", F.col("user_id").cast("string"))
    out, _ = _run(v, "delivery", lambda p, c: jobs.delivery_stream(
        ended(v, results, "end of results"), ended(v, signs, "end of signs"), p, c))
    return sinks.read(v.spark, out, "event_id long, user_id string, sid string, tier string")


@query("t08_trailing_activity_stream", """
    SELECT community_id, day, count(*) AS message_count FROM (
      SELECT community_id, unnest(generate_series(CAST(created_at AS DATE), CAST(created_at AS DATE) + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS day
      FROM activity) GROUP BY 1, 2""")
def t08(v):
    out, _ = _run(v, "activity", lambda p, c: jobs.daily_activity_stream(_streams(v).activity, p, c))
    return jobs.trailing_counts(jobs.daily_counts(v.spark, out)).select("community_id", "day", "message_count")
