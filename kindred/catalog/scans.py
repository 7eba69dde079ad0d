"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import AS_OF, DIM, as_of, query
from kindred.functions.vectors import norm
from kindred.operators import lookups
from kindred.plans import ledger
from kindred.plans.matching import location_candidates, match_results
from kindred.plans.preferences import fold
from kindred.schemas import AWARD_RULES
from kindred.session import shared_dir
from kindred.sources import messages, tables
from kindred.sources.tables import conform
from kindred.streaming import jobs, sinks


def scanned(df, name: str):
    """The rows as a table of the declared schema, written once and read back by the typed scan."""
    path = shared_dir(df.sparkSession, name)
    conform(df, name).write.parquet(path)
    return tables.read_table(df.sparkSession, path, name)


def micros(df, *columns: str):
    """Times with a zone as microseconds, which both engines show alike."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query("s01_scan_communities", """
    SELECT CAST(community_id AS VARCHAR) AS community_id, community_name, category, city, timezone,
           member_count, description, is_active, CAST(NULL AS TIMESTAMP) AS created_at
    FROM communities""")
def s01_communities(v):
    return scanned(v.communities, "communities")


@query("s01_scan_community_members", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(community_id AS VARCHAR) AS community_id,
           CAST(NULL AS TIMESTAMP) AS joined_at, CAST(NULL AS BOOLEAN) AS auto_joined FROM members""")
def s01_members(v):
    return scanned(v.members, "community_members")


@query("s01_scan_community_activity", """
    SELECT CAST(message_id AS VARCHAR) AS message_id, CAST(community_id AS VARCHAR) AS community_id,
           CAST(user_id AS VARCHAR) AS user_id, created_at FROM activity""")
def s01_activity(v):
    return scanned(v.activity, "community_activity")


@query("s01_scan_users", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, username, CAST(NULL AS VARCHAR) AS bio, CAST(NULL AS TIMESTAMP) AS created_at,
           CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS first_name, CAST(NULL AS VARCHAR) AS last_name,
           CAST(NULL AS VARCHAR) AS public_metadata, is_active, threshold AS inbox_shield_threshold
    FROM users JOIN shield USING (user_id)""")
def s01_users(v):
    users = v.users.join(v.shield.withColumnRenamed("threshold", "inbox_shield_threshold"), "user_id")
    return scanned(users, "users")


@query("s01_scan_karma_ledger", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, point_delta, action_type,
           CAST(reference_id AS VARCHAR) AS reference_id, CAST(epoch_us(created_at) AS BIGINT) AS created_at
    FROM ledger""")
def s01_ledger(v):
    return micros(scanned(v.ledger, "karma_ledger"), "created_at")


@query("s01_scan_user_preferences", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, location, recharge_method, natural_rhythm, ideal_group_size,
           weekend_trip, weekend_env, background_vibe, CAST(NULL AS BOOLEAN) AS onboarding_complete,
           CAST(epoch_us(created_at) AS BIGINT) AS created_at, CAST(NULL AS BIGINT) AS updated_at FROM pref_patches""")
def s01_preferences(v):
    return micros(scanned(v.pref_patches, "user_preferences"), "created_at", "updated_at")


_RULE_VALUES = ", ".join(f"('{a}', {p}, {i})" for i, (a, p, _, _) in enumerate(AWARD_RULES))


@query("s02_inline_values", f"""
    SELECT coalesce(l.action_type, r.action_type) AS action_type, CAST(points AS INTEGER) AS documented,
           TIMESTAMP '{AS_OF}' - to_days(CAST(days AS INTEGER)) AS seeded_at, count(id) AS awards,
           count(CASE WHEN created_at <= TIMESTAMP '{AS_OF}' - to_days(CAST(days AS INTEGER)) THEN 1 END) AS before,
           CAST(coalesce(sum(point_delta), 0) AS BIGINT) AS paid
    FROM ledger l FULL JOIN (VALUES {_RULE_VALUES}) r(action_type, points, days) ON l.action_type = r.action_type
    GROUP BY 1, 2, 3""")
def s02(v):
    """Seed rows, each some days before the run, next to all awards: kinds without a seed row stay too."""
    rules = v.spark.sql(f"SELECT * FROM VALUES {_RULE_VALUES} AS r(kind, documented, days)").withColumn(
        "seeded_at", as_of() - F.make_dt_interval(days=F.col("days")))
    per_day = v.ledger.groupBy("action_type", "created_at").agg(
        F.count("id").alias("n"), F.sum("point_delta").alias("points"))
    joined = per_day.join(rules, F.col("action_type") == F.col("kind"), "full")
    return joined.groupBy(F.coalesce("action_type", "kind").alias("action_type"), "documented", "seeded_at").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("awards"),
        F.coalesce(F.sum(F.when(F.col("created_at") <= F.col("seeded_at"), F.col("n"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum("points"), F.lit(0)).alias("paid"))


def profile_messages(v):
    """Profiles as JSON; every seventh message is truncated, every eleventh lacks the city."""
    p = v.profiles.withColumn("city", F.when(F.col("user_id") % 11 != 4, F.lit("NATION_1")))
    text = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "bio", "interest_tags",
                              "city", F.lit("AMERICA").alias("timezone")))
    return p.select(F.col("user_id").alias("message_id"), F.when(
        F.col("user_id") % 7 == 3, F.substring(text, 1, 30)).otherwise(text).alias("value"))


@query("s03_profile_source", """
    SELECT user_id AS message_id, CASE WHEN user_id % 7 = 3 OR user_id % 11 = 4 THEN 'malformed' ELSE 'typed' END AS status,
           CASE WHEN user_id % 7 = 3 OR user_id % 11 = 4 THEN NULL ELSE bio END AS bio,
           CASE WHEN user_id % 7 = 3 OR user_id % 11 = 4 THEN NULL ELSE len(interest_tags) END AS n_tags
    FROM profiles""")
def s03(v):
    typed, bad = messages.parse_profiles(profile_messages(v))
    typed = typed.select("message_id", F.lit("typed").alias("status"), "bio",
                         F.size("interest_tags").cast("long").alias("n_tags"))
    return typed.unionByName(bad.select("message_id", F.lit("malformed").alias("status"),
                                        F.lit(None).cast("string").alias("bio"),
                                        F.lit(None).cast("long").alias("n_tags")))


@query("s04_change_event_source", """
    SELECT event_id, type, CAST(user_id AS VARCHAR) AS user_id, email, first_name, last_name, public_metadata
    FROM change_events WHERE event_id % 97 <> 5""")
def s04(v):
    return messages.parse_change_events(v.change_messages).drop("ts")


@query("s05_restricted_vector_scan", """
    SELECT vec_id AS community_id, label, len(embedding) AS dims,
           round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
    FROM embeddings WHERE vec_id IN (SELECT community_id FROM candidates)""")
def s05(v):
    allowed = location_candidates(v.communities, v.activity, as_of())
    index = v.table("embeddings").withColumnRenamed("vec_id", "community_id")
    return (lookups.restrict(index, allowed, "community_id")
            .select("community_id", "label", F.size("embedding").cast("long").alias("dims"),
                    F.round(norm(F.col("embedding")), 6).alias("norm")))


@query("s06_keyed_lookups", f"""
    SELECT e.event_id, e.target AS user_id, karma_score, CAST(coalesce(threshold, 0) AS INTEGER) AS inbox_shield
    FROM (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN user_id + 1000000000 ELSE user_id END AS target FROM events) e
    LEFT JOIN karma ON karma.user_id = e.target LEFT JOIN shield ON shield.user_id = e.target""")
def s06(v):
    requests = v.events.select("event_id", F.when(
        F.col("event_id") % 19 == 0, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id")).alias("user_id"))
    found = lookups.lookup(requests, ledger.scores(v.users, v.ledger), "user_id")
    shields = v.shield.withColumnRenamed("threshold", "inbox_shield")
    return lookups.lookup(found, shields, "user_id", {"inbox_shield": F.lit(0)})


@query("s06_preference_lookup", """
    SELECT u.user_id, p.location, p.natural_rhythm, p.user_id IS NOT NULL AS found
    FROM users u LEFT JOIN (
      SELECT user_id, arg_max(location, seq) AS location, arg_max(natural_rhythm, seq) AS natural_rhythm
      FROM pref_patches GROUP BY 1) p USING (user_id)""")
def s06_preferences(v):
    folded = fold(v.pref_patches).select("user_id", "location", "natural_rhythm", F.lit(True).alias("found"))
    return lookups.lookup(v.users.select("user_id"), folded, "user_id", {"found": F.lit(False)})


@query("s07_ledger_append_sink", """
    SELECT user_id, action_type, point_delta, CAST(reference_id AS VARCHAR) AS reference_id,
           CAST(created_at AS DATE) AS entry_date, CAST(epoch_us(created_at) AS BIGINT) AS created_us
    FROM checked_awards WHERE reason IS NULL""")
def s07(v):
    path = shared_dir(v.spark, "ledger")
    accepted = ledger.check_awards(v.award_requests, v.users).filter("reason IS NULL")
    tables.append_ledger(
        accepted.select("user_id", "action_type", "point_delta",
                        F.col("reference_id").cast("string").alias("reference_id"),
                        F.col("created_at").cast("timestamp").alias("created_at")),
        path, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return v.spark.read.parquet(path).select(
        "user_id", "action_type", "point_delta", "reference_id", "entry_date",
        F.unix_micros("created_at").alias("created_us"))


def published(v):
    """Whole match results, with a request id, as keyed messages."""
    results = match_results(
        v.user_vectors.withColumn("request_id", F.concat(F.lit("req-"), "user_id")), v.communities, v.index,
        v.activity, v.members, as_of(), v.toxicity, keep=["request_id", "user_id"], population=v.users, dim=DIM)
    return messages.keyed_messages(results.withColumn("created_at", as_of()))


@query("s08_keyed_publish", f"""
    SELECT 'match_updates_' || r.user_id AS key, 'req-' || r.user_id AS request_id, r.tier, n_matches, first_match,
           r.auto_joined_community, r.ai_intro_generated, r.requires_profile_update, TIMESTAMP '{AS_OF}' AS created_at
    FROM results r JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS n_matches,
                                max(CASE WHEN position = 1 THEN 'Community#' || community_id END) AS first_match
                         FROM emitted GROUP BY 1) e USING (user_id)""")
def s08(v):
    """Fields picked from the published JSON by path."""
    def path(p: str):
        return F.get_json_object("value", p)

    return published(v).select(
        "key", path("$.request_id").alias("request_id"), path("$.tier").alias("tier"),
        F.json_array_length(path("$.matches")).cast("long").alias("n_matches"),
        path("$.matches[0].community_name").alias("first_match"),
        path("$.auto_joined_community").cast("long").alias("auto_joined_community"),
        path("$.ai_intro_generated").cast("boolean").alias("ai_intro_generated"),
        path("$.requires_profile_update").cast("boolean").alias("requires_profile_update"),
        path("$.created_at").cast("timestamp_ntz").alias("created_at"))


def on_the_wire(v):
    """Published results among other traffic: some on other channels, some cut short."""
    user = F.regexp_extract("key", r"(\d+)$", 1).cast("long")
    return published(v).select(
        F.when(user % 5 == 0, F.concat(F.lit("audit_"), user)).otherwise(F.col("key")).alias("key"),
        F.when(user % 13 == 2, F.substring("value", 1, 60)).otherwise(F.col("value")).alias("value"))


@query("s09_pattern_subscribe", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, tier, position, community_id, match_score FROM emitted
    WHERE user_id % 5 <> 0 AND user_id % 13 <> 2""")
def s09(v):
    """Results read back from their messages, one row per match."""
    schema = "tier string, matches array<struct<community_id:long,match_score:double>>"
    parsed = messages.parse_results(on_the_wire(v), schema).withColumn("tier", F.col("result.tier"))
    return parsed.select("user_id", "tier", F.posexplode("result.matches").alias("p", "m")).select(
        "user_id", "tier", (F.col("p") + 1).alias("position"), F.col("m.community_id").alias("community_id"),
        F.round("m.match_score", 6).alias("match_score"))


@query("s09_stream_round_trip", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, tier, position, community_id, match_score FROM emitted""")
def s09_stream(v):
    """Results as a stream into the file sink as messages, read back from there as a stream."""
    base = shared_dir(v.spark, "mail")
    match_results(v.user_vectors, v.communities, v.index, v.activity, v.members, as_of(), v.toxicity, population=v.users,
                  dim=DIM).write.parquet(f"{base}/results")
    results = v.spark.readStream.schema(v.spark.read.parquet(f"{base}/results").schema).parquet(f"{base}/results")
    jobs.publish_stream(results, f"{base}/wire", f"{base}/sent").awaitTermination()
    schema = "tier string, matches array<struct<community_id:long,match_score:double>>"
    received = jobs.subscribe_stream(v.spark, f"{base}/wire", schema).select(
        "user_id", "result.tier", F.posexplode("result.matches").alias("p", "m")).select(
        "user_id", "tier", (F.col("p") + 1).alias("position"), F.col("m.community_id").alias("community_id"),
        F.round("m.match_score", 6).alias("match_score"))
    sinks.append(received, f"{base}/received", f"{base}/read").awaitTermination()
    return sinks.read(v.spark, f"{base}/received", "user_id string, tier string, position int, community_id long, match_score double")
