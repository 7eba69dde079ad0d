"""Per-key ranks, running values and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import DIM, POPULARITY_SQL, as_of, query, tier_sql
from kindred.operators.skew import top_k_per_key
from kindred.operators.similarity import top_k_by_cosine
from kindred.plans import ledger, matching, preferences, users
from kindred.schemas import PREFERENCE_FIELDS


@query("w01_candidate_cap", f"""
    SELECT city, timezone, community_id, CAST(rn AS INTEGER) AS candidate_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY city, timezone ORDER BY {POPULARITY_SQL}) AS rn
      FROM scored_communities WHERE is_active) WHERE rn <= 5""")
def w01(v):
    capped = matching.location_candidates(v.communities, v.activity, as_of(), cap=5)
    return capped.select("city", "timezone", "community_id", "candidate_rank")


@query("w02_top_per_user", """
    SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20""")
def w02(v):
    """Top 20 of long-form rows, most users having more: events by value."""
    return top_k_per_key(v.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 20, salt_on=["event_id"]).select(
        "user_id", "event_id", "rn")


@query("w03_top_members", """
    SELECT community_id, user_id, username, message_count, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY message_count DESC, user_id) AS rn FROM (
        SELECT m.community_id, u.user_id, u.username, count(a.message_id) AS message_count
        FROM users u JOIN members m USING (user_id)
        LEFT JOIN activity a ON a.user_id = u.user_id AND a.community_id = m.community_id
             AND a.created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
        GROUP BY 1, 2, 3)) WHERE rn <= 5""")
def w03(v):
    return matching.active_members(v.users, v.members, v.activity, as_of())


_PAGE = """
    SELECT user_id, id, action_type, point_delta, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM ledger)
    WHERE rn BETWEEN %d AND %d"""


@query("w04_ledger_page", _PAGE % (6, 15))
def w04(v):
    return ledger.ledger_page(v.ledger, limit=10, offset=5).select(
        "user_id", "id", "action_type", "point_delta", "rn")


@query("w04_ledger_deep_page", _PAGE % (31, 2030))
def w04_deep(v):
    return ledger.ledger_page(v.ledger, limit=2000, offset=30).select(
        "user_id", "id", "action_type", "point_delta", "rn")


@query("w05_diversity_rerank", "SELECT user_id, community_id, new_rank FROM reranked")
def w05(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    long = top_k_by_cosine(v.user_vectors, candidates, v.index, DIM, population=v.users).select(
        "user_id", F.posexplode("matches").alias("p", "m")).select(
        "user_id", (F.col("p") + 1).alias("rn"), "m.community_id", "m.category")
    return matching.diversity_ranks(long).select("user_id", "community_id", "new_rank")


@query("w06_running_balance", f"""
    SELECT id, user_id, balance, {tier_sql("balance")} AS tier FROM (
      SELECT *, CAST(sum(point_delta) OVER (PARTITION BY user_id ORDER BY created_at, id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM ledger)""")
def w06(v):
    return ledger.running_balance(v.ledger).select("id", "user_id", "balance", "tier")


_LAST = ",\n".join(
    f"last_value({f} IGNORE NULLS) OVER w AS cur_{f}" for f in PREFERENCE_FIELDS)


@query("w07_patch_fold", f"""
    SELECT seq, user_id, {", ".join("cur_" + f for f in PREFERENCE_FIELDS)},
           ({" AND ".join(f"cur_{f} IS NOT NULL" for f in PREFERENCE_FIELDS)}) AS onboarding_complete
    FROM (SELECT seq, user_id, {_LAST} FROM pref_patches
          WINDOW w AS (PARTITION BY user_id ORDER BY created_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def w07(v):
    return preferences.history(v.pref_patches).select(
        "seq", "user_id", *[f"cur_{f}" for f in PREFERENCE_FIELDS], "onboarding_complete")


@query("w08_latest_event", """
    SELECT user_id, event_id, type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM change_events
      WHERE type <> 'session.started') WHERE rn = 1""")
def w08(v):
    return users.fold_events(v.change_events).select(
        "user_id", "last_at.event_id", F.col("last_type").alias("type"))


@query("w09_award_caps", """
    SELECT id, user_id, action_type, CAST(CASE
      WHEN action_type = 'SIGNUP_EMAIL_VERIFY' AND nth > 1 THEN 0
      WHEN action_type = 'EVENT_RSVP' AND nth > 3 THEN 0
      WHEN action_type = 'GPS_CHECKIN' AND nth > 1 THEN 0
      ELSE point_delta END AS INTEGER) AS earned
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, action_type, scope ORDER BY created_at, id) AS nth
          FROM (SELECT *, CASE action_type WHEN 'EVENT_RSVP' THEN strftime(created_at, '%Y-%m-%d')
                               WHEN 'GPS_CHECKIN' THEN coalesce('event ' || reference_id, 'row ' || id) ELSE 'once' END AS scope FROM ledger))""")
def w09(v):
    return ledger.apply_caps(v.ledger).select("id", "user_id", "action_type", "earned")
