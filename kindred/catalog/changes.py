"""Set operations and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import ALL_FIELDS_SQL, LATEST_FIELDS_SQL, SINCE, as_of, query
from kindred.operators.validation import union_all
from kindred.plans import matching, preferences, users
from kindred.schemas import PREFERENCE_FIELDS
from kindred.session import shared_dir
from kindred.sources import tables


@query("u01_union_counts", f"""
    SELECT 'communities' AS info, count(*) AS n FROM communities
    UNION ALL SELECT 'users', count(*) FROM users
    UNION ALL SELECT 'recent activity', count(*) FROM activity WHERE created_at >= {SINCE}
    UNION ALL SELECT 'memberships', count(*) FROM members""")
def u01(v):
    def counted(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("info"), "n")
    return union_all([
        counted(v.communities, "communities"), counted(v.users, "users"),
        counted(matching.recent_rows(v.activity, as_of()), "recent activity"),
        counted(v.members, "memberships")])


def synced_users(v):
    """Users before any event: sync columns unset; the inactive ones are not known yet."""
    return (v.users.filter("is_active").select("user_id", "username", "is_active")
            .withColumns({c: F.lit(None).cast("string") for c in users.SYNC_COLUMNS}))


SYNC_SQL = """
    SELECT coalesce(u.user_id, f.user_id) AS user_id, u.username,
           f.email, f.first_name, f.last_name, f.public_metadata,
           CASE WHEN l.type = 'user.deleted' THEN FALSE WHEN f.user_id IS NOT NULL THEN TRUE ELSE u.is_active END AS is_active
    FROM (SELECT * FROM users WHERE is_active) u
    FULL JOIN (SELECT * FROM change_events WHERE type IN ('user.created', 'user.updated') {where}
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) f ON u.user_id = f.user_id
    LEFT JOIN (SELECT * FROM change_events WHERE type <> 'session.started' {where}
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) l
      ON l.user_id = coalesce(u.user_id, f.user_id)"""


@query("u02_full_upsert", SYNC_SQL.replace("l.type = 'user.deleted'", "FALSE").format(where=""))
def u02(v):
    upserts = v.change_events.filter(F.col("type").isin(users.UPSERTS))
    return users.sync(synced_users(v), upserts)


@query("u02_bucketed_upsert", SYNC_SQL.format(where=""))
def u02_bucketed(v):
    """The users stored by id: only the day's events move, and the next snapshot is stored the same way."""
    names = [shared_dir(v.spark, n) for n in ("users", "snapshot")]
    stored, snapshot = ([p.rsplit("/", 1)[-1].replace("-", "_"), p, "user_id", 8] for p in names)
    return tables.save_bucketed(users.sync(tables.save_bucketed(synced_users(v), *stored), v.change_events), *snapshot)


@query("u03_soft_delete", """
    SELECT user_id, username, is_active AND user_id NOT IN (SELECT user_id FROM change_events WHERE type = 'user.deleted') AS is_active
    FROM users""")
def u03(v):
    deleted = v.change_events.filter(F.col("type") == users.DELETE)
    return users.soft_delete(v.users, deleted).select("user_id", "username", "is_active")


_HALF = "TIMESTAMP '2024-01-16'"
_BOTH = ", ".join(f"coalesce(n.{f}, c.{f}) AS {f}" for f in PREFERENCE_FIELDS)
UPSERT_SQL = f"""
    SELECT *, ({ALL_FIELDS_SQL}) AS onboarding_complete FROM (
      SELECT coalesce(c.user_id, n.user_id) AS user_id, {_BOTH},
             CAST(coalesce(c.first_at, TIMESTAMP '2024-01-31') AS DATE) AS created_on,
             CAST(CASE WHEN n.user_id IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE c.last_at END AS DATE) AS updated_on
      FROM (SELECT user_id, {LATEST_FIELDS_SQL}, min(created_at) AS first_at, max(created_at) AS last_at
            FROM pref_patches WHERE created_at < {_HALF} GROUP BY 1) c
      FULL JOIN (SELECT user_id, {LATEST_FIELDS_SQL} FROM pref_patches WHERE created_at >= {_HALF} GROUP BY 1) n
      ON c.user_id = n.user_id)"""


def stored_preferences(v):
    """What was stored after the first half of the patches."""
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = preferences.fold(v.pref_patches.filter(F.col("created_at") < half))
    new = v.pref_patches.filter(F.col("created_at") >= half)
    return old.withColumnsRenamed({"first_patch_at": "created_at", "last_patch_at": "updated_at"}), new


@query("u04_partial_upsert", UPSERT_SQL)
def u04(v):
    stored, patches = stored_preferences(v)
    return (preferences.upsert(stored, preferences.fold(patches), as_of())
            .withColumn("created_on", F.to_date("created_at")).withColumn("updated_on", F.to_date("updated_at"))
            .drop("created_at", "updated_at"))


@query("u05_shield_update", """
    SELECT s.user_id, CAST(coalesce(n.threshold, s.threshold) AS INTEGER) AS inbox_shield_threshold
    FROM shield s LEFT JOIN (
      SELECT user_id, arg_max(event_id % 700 - 50, event_id) AS threshold FROM events
      WHERE event_id % 10 <> 0 AND event_id % 700 - 50 >= 0 GROUP BY 1) n USING (user_id)""")
def u05(v):
    e = F.col("event_id")
    updates = v.events.select(
        F.when(e % 10 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("requester_id"),
        "user_id", (e % 700 - 50).cast("int").alias("threshold"), "ts", e.alias("seq"))
    return users.set_shields(v.shield.withColumnRenamed("threshold", "inbox_shield_threshold"), updates)


@query("u06_backfill", """
    SELECT user_id, coalesce(CASE WHEN user_id % 13 <> 0 THEN is_active END, TRUE) AS is_active, 0 AS karma_score,
           0 AS inbox_shield_threshold, '{}' AS public_metadata FROM users""")
def u06(v):
    old = v.users.select("user_id", F.when(F.col("user_id") % 13 != 0, F.col("is_active")).alias("is_active"))
    return users.add_columns(old, {
        "is_active": F.lit(True), "karma_score": F.lit(0), "inbox_shield_threshold": F.lit(0),
        "public_metadata": F.lit("{}")})


@query("u07_touch_updated_at", f"SELECT user_id, created_on, updated_on FROM ({UPSERT_SQL})")
def u07(v):
    stored, patches = stored_preferences(v)
    return preferences.upsert(stored, preferences.fold(patches), as_of()).select(
        "user_id", F.to_date("created_at").alias("created_on"), F.to_date("updated_at").alias("updated_on"))
