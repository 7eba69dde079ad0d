"""Projections, predicates and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import (
    ALL_FIELDS_SQL, LATEST_FIELDS_SQL, SINCE, as_of, query, strip_sql)
from kindred.functions.karma import award_rejection
from kindred.functions.matching import model_approved, postable
from kindred.functions.text import strip
from kindred.operators import validation as V
from kindred.operators.lookups import restrict
from kindred.plans import preferences
from kindred.plans.matching import message_counts, recent_rows
from kindred.schemas import KARMA_ACTIONS, PREFERENCE_CHOICES


@query("f01_projection", "SELECT community_id AS id, community_name AS name, category, member_count FROM communities")
def f01(v):
    return v.communities.select(F.col("community_id").alias("id"), F.col("community_name").alias("name"),
                                "category", "member_count")


@query("f02_location_filter", """
    SELECT u.user_id, count(*) AS n_communities, min(c.community_id) AS first_id, max(c.community_id) AS last_id,
           CAST(sum(c.community_id) AS BIGINT) AS sum_of_ids
    FROM users u JOIN communities c USING (city, timezone) WHERE c.is_active GROUP BY 1""")
def f02(v):
    """All active communities at each user's location, folded to one row per user.

    Users of a place see the same communities, so each place is folded once.
    """
    at = v.communities.filter("is_active").groupBy("city", "timezone").agg(
        F.count(F.lit(1)).alias("n_communities"), F.min("community_id").alias("first_id"),
        F.max("community_id").alias("last_id"), F.sum("community_id").alias("sum_of_ids"))
    return v.users.join(at, ["city", "timezone"]).select("user_id", "n_communities", "first_id", "last_id", "sum_of_ids")


@query("f02_communities_at", """
    SELECT city, timezone, count(*) AS n, min(community_id) AS first_id FROM communities
    WHERE city = 'NATION_7' AND timezone = 'ASIA' AND is_active GROUP BY 1, 2""")
def f02_at(v):
    at = (F.col("city") == "NATION_7") & (F.col("timezone") == "ASIA") & F.col("is_active")
    return v.communities.filter(at).groupBy("city", "timezone").agg(
        F.count(F.lit(1)).alias("n"), F.min("community_id").alias("first_id"))


@query("f03_trailing_window", f"SELECT message_id, community_id, created_at FROM activity WHERE created_at >= {SINCE}")
def f03(v):
    return recent_rows(v.activity, as_of()).select("message_id", "community_id", "created_at")


@query("f04_set_membership", """
    SELECT community_id, community_name, category, member_count, description FROM communities
    WHERE community_id IN (SELECT community_id FROM recent)""")
def f04(v):
    return restrict(v.communities, message_counts(v.activity, as_of()), "community_id").select(
        "community_id", "community_name", "category", "member_count", "description")


@query("f05_active_user_guard", """
    SELECT seq, p.user_id, CASE WHEN u.user_id IS NULL THEN 'not found' END AS reason
    FROM pref_patches p LEFT JOIN (SELECT user_id FROM users WHERE is_active) u USING (user_id)""")
def f05(v):
    return V.known_active(v.pref_patches.select("seq", "user_id"), v.users)


@query("f06_self_only_guard", """
    SELECT seq, CASE WHEN requester_id <> user_id THEN 'forbidden' END AS reason FROM patch_requests""")
def f06(v):
    rule = V.self_only_rule(F.col("requester_id"), F.col("user_id"))
    return V.with_reason(v.patch_requests, [rule]).select("seq", "reason")


@query("f07_onboarded_cohort", f"""
    SELECT user_id, location FROM (SELECT user_id, {LATEST_FIELDS_SQL} FROM pref_patches GROUP BY 1) WHERE {ALL_FIELDS_SQL}""")
def f07(v):
    return preferences.fold(v.pref_patches).filter("onboarding_complete").select("user_id", "location")


@query("f08_enum_domain_actions", "SELECT id, 'action_type not a choice' AS reason FROM award_requests WHERE action_type = 'BONUS'")
def f08_actions(v):
    return V.enum_violations(v.award_requests, {"action_type": KARMA_ACTIONS}).select("id", "reason")


@query("f08_enum_domain_preferences", """
    SELECT seq, 'natural_rhythm not a choice' AS reason FROM patch_requests WHERE natural_rhythm = 'Party all night'""")
def f08_preferences(v):
    return V.enum_violations(v.patch_requests, PREFERENCE_CHOICES).select("seq", "reason")


@query("f09_bio_rule", f"""
    SELECT user_id, CASE WHEN length(bio) < 10 THEN 'bio too short' WHEN length(bio) > 500 THEN 'bio too long'
           WHEN length({strip_sql("bio")}) < 10 THEN 'bio blank' END AS reason, {strip_sql("bio")} AS bio FROM profiles""")
def f09(v):
    return V.with_reason(v.profiles, [V.bio_rule(F.col("bio"))]).select(
        "user_id", "reason", strip(F.col("bio")).alias("bio"))


@query("f10_location_rule", f"""
    SELECT seq, {strip_sql("location")} AS location,
           CASE WHEN length({strip_sql("location")}) NOT BETWEEN 2 AND 100 THEN 'location length' END AS reason
    FROM patch_requests WHERE location IS NOT NULL""")
def f10(v):
    given = v.patch_requests.filter("location IS NOT NULL")
    return V.with_reason(given, [V.location_rule(F.col("location"))]).select(
        "seq", strip(F.col("location")).alias("location"), "reason")


@query("f11_tag_count_rule", """
    SELECT user_id, len(tags) AS n_tags, CASE WHEN len(tags) NOT BETWEEN 1 AND 20 THEN 'tag count' END AS reason
    FROM (SELECT user_id, string_split(bio, chr(10)) AS tags FROM profiles)""")
def f11(v):
    """The lines of each text as its tag list, so that sizes vary."""
    listed = v.profiles.select("user_id", F.split("bio", "\n").alias("tags"))
    return V.with_reason(listed, [V.tag_count_rule(F.col("tags"))]).select(
        "user_id", F.size("tags").cast("long").alias("n_tags"), "reason")


@query("f12_numeric_ranges", """
    SELECT event_id, CASE WHEN value / 100 NOT BETWEEN 0 AND 1 THEN 'score range'
                          WHEN user_id % 7 - 1 < 0 THEN 'shield range'
                          WHEN event_id % 120 NOT BETWEEN 1 AND 100 THEN 'limit range'
                          WHEN event_id % 9 - 1 < 0 THEN 'offset range' END AS reason FROM events""")
def f12(v):
    e, u = F.col("event_id"), F.col("user_id")
    rules = [V.range_rule(F.col("value") / 100, 0, 1, "score range"), V.range_rule(u % 7 - 1, 0, None, "shield range"),
             V.range_rule(e % 120, 1, 100, "limit range"), V.range_rule(e % 9 - 1, 0, None, "offset range")]
    return V.with_reason(v.events, rules).select("event_id", "reason")


@query("f13_sign_rule", """
    SELECT id, CASE WHEN action_type = 'BONUS' THEN 'unknown action'
            WHEN action_type = 'NO_SHOW_PENALTY' AND point_delta > 0 THEN 'penalty must be negative'
            WHEN action_type NOT IN ('NO_SHOW_PENALTY', 'ADMIN_ADJUSTMENT') AND point_delta < 0 THEN 'reward must be positive' END AS reason
    FROM award_requests""")
def f13(v):
    rule = award_rejection(F.col("action_type"), F.col("point_delta"))
    return V.with_reason(v.award_requests, [rule]).select("id", "reason")


@query("f14_some_field", """
    SELECT seq, CASE WHEN coalesce(location, recharge_method, natural_rhythm, ideal_group_size, weekend_trip, weekend_env,
           background_vibe) IS NULL THEN 'empty patch' END AS reason FROM patch_requests""")
def f14(v):
    return V.with_reason(v.patch_requests, [V.some_field_rule()]).select("seq", "reason")


@query("f15_toxicity_gate", """
    SELECT event_id, score, score < 0.75 AS postable, NOT score > 0.75 AS approved
    FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS score FROM events)""")
def f15(v):
    s = F.col("event_id") % 101 / 100.0
    return v.events.select("event_id", s.alias("score"), postable(s).alias("postable"),
                           model_approved(s).alias("approved"))


# Of every table its true key, further unique columns, and the columns that must not be null.
CONSTRAINTS = {
    "communities": (["community_id"], [], ["community_name", "city", "description"]),
    "members": (["user_id", "community_id"], [], ["user_id", "community_id"]),
    "activity": (["message_id"], [], ["community_id", "user_id", "created_at"]),
    "users": (["user_id"], ["username"], ["username", "is_active"]),
    "ledger": (["id"], [], ["user_id", "action_type", "point_delta"]),
    "pref_patches": (["seq"], [], ["user_id", "created_at"]),
}


def _constraint_sql() -> str:
    parts = []
    for name, (key, unique, required) in CONSTRAINTS.items():
        for columns, label in ((key, "duplicate key"), *(([u], f"duplicate {u}") for u in unique)):
            parts.append(f"SELECT '{name}' AS table_name, '{label}' AS check_name, count(*) AS violations "
                         f"FROM (SELECT 1 FROM {name} GROUP BY {', '.join(columns)} HAVING count(*) > 1)")
        parts += [f"SELECT '{name}', 'null {c}', count(*) FILTER ({c} IS NULL) FROM {name}" for c in required]
    return " UNION ALL ".join(parts)


@query("f16_key_constraints", _constraint_sql())
def f16(v):
    checks = []
    for name, (key, unique, required) in CONSTRAINTS.items():
        checks.append(V.key_violations(getattr(v, name), name, key, required))
        checks += [V.key_violations(getattr(v, name), name, [u], [], f"duplicate {u}") for u in unique]
    return V.union_all(checks)


@query("f17_orphans", """
    SELECT 'activity.community_id' AS constraint_name, community_id AS orphan_key, count(*) AS n_rows FROM activity
    WHERE community_id NOT IN (SELECT community_id FROM communities WHERE is_active) GROUP BY 2
    UNION ALL SELECT 'members.community_id', community_id, count(*) FROM members
    WHERE community_id NOT IN (SELECT community_id FROM communities WHERE is_active) GROUP BY 2
    UNION ALL SELECT 'award_requests.user_id', user_id, count(*) FROM award_requests
    WHERE user_id NOT IN (SELECT user_id FROM users) GROUP BY 2
    UNION ALL SELECT 'pref_patches.user_id', user_id, count(*) FROM pref_patches
    WHERE user_id NOT IN (SELECT user_id FROM users WHERE is_active) GROUP BY 2""")
def f17(v):
    live, active = v.communities.filter("is_active"), v.users.filter("is_active")
    return V.union_all([
        V.orphans(v.activity, live, "community_id", "community_id", "activity.community_id"),
        V.orphans(v.members, live, "community_id", "community_id", "members.community_id"),
        V.orphans(v.award_requests, v.users, "user_id", "user_id", "award_requests.user_id"),
        V.orphans(v.pref_patches, active, "user_id", "user_id", "pref_patches.user_id"),
    ])
