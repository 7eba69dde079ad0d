"""User-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred import hooks
from kindred.catalog.base import (
    ALL_FIELDS_SQL, AS_OF, DIM, LATEST_FIELDS_SQL, as_of, label_sql, level_sql, next_sql, query, strip_sql, tier_sql)
from kindred.catalog.changes import SYNC_SQL, stored_preferences, synced_users
from kindred.catalog.scalars import ELIGIBLE_SQL, EMAIL_SQL, PHONE_SQL, TAGS_SQL, TOKEN_BREAK_SQL
from kindred.functions import text as X
from kindred.operators import validation as V
from kindred.plans import ledger, matching, preferences, requests, users
from kindred.schemas import PREFERENCE_FIELDS, VECTOR_DIM
from kindred.session import settle, shared_dir
from kindred.sources import messages


def decided(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    popular = matching.popular_communities(v.communities, v.activity, as_of())
    return matching.decide(matching.top_matches(v.user_vectors, candidates, v.index, dim=DIM, population=v.users), popular)


def accepted_profiles(v):
    """Valid profiles, cleaned, with their owner's location and vector; null for owners that are not known."""
    cleaned, _ = requests.prepare(v.profiles)
    return cleaned.select("user_id", "embedding_text", "pii_removed").join(v.user_vectors, "user_id", "left")


# Valid profiles with the text that is embedded.
TEXTS_SQL = f"""
    SELECT user_id, 'Bio: ' || regexp_replace(regexp_replace({strip_sql("bio")}, {EMAIL_SQL}), {PHONE_SQL}) || chr(10) || 'Interests: '
           || array_to_string(tags, ', ') AS text
    FROM (SELECT *, list_sort(list_distinct(list_concat({TAGS_SQL}, list_filter([
            {", ".join(f"CASE WHEN list_contains(regexp_split_to_array(lower({strip_sql('bio')}), '[^a-z0-9]+'), '{w}') THEN '{t}' END" for w, t in X.TAG_RULES)}
          ], lambda t: t IS NOT NULL)))) AS tags FROM profiles
          WHERE length(bio) BETWEEN 10 AND 500 AND length({strip_sql("bio")}) >= 10)"""


def weights_sql(texts: str, key: str) -> str:
    """The hashed-token vector of every text as (key, slot, w), weights in 32 bits, scaled to length 1 again in doubles."""
    return f"""
      SELECT {key}, slot, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, slot, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w FROM (
          SELECT {key}, slot, CAST(count(*) AS DOUBLE) AS n FROM (
            SELECT {key}, CAST('0x' || substr(md5(token), 1, 7) AS INTEGER) % {VECTOR_DIM} AS slot
            FROM (SELECT {key}, unnest(string_split_regex(lower(text), '{TOKEN_BREAK_SQL}')) AS token FROM ({texts}))
            WHERE token <> '') GROUP BY 1, 2))"""


# The matching of texts: both sides are embedded.
TEXT_VIEWS = {
    "user_vectors": f"SELECT user_id, username, city, timezone, text FROM ({TEXTS_SQL}) LEFT JOIN users USING (user_id)",
    "sims": f"""
      SELECT u.user_id, c.community_id, c.community_name, c.category, c.member_count, c.recent_activity,
             round(coalesce(d.dot, 0), 12) AS score
      FROM user_vectors u JOIN candidates c USING (city, timezone) LEFT JOIN (
        SELECT a.user_id, b.community_id, sum(a.w * b.w) AS dot
        FROM (SELECT * FROM ({weights_sql("SELECT user_id, text FROM user_vectors", "user_id")}) JOIN users USING (user_id)) a
        JOIN (SELECT * FROM ({weights_sql("SELECT community_id, concat_ws(' ', community_name, category, description) AS text FROM communities", "community_id")})
              JOIN (SELECT community_id, city, timezone FROM communities) USING (community_id)) b
          ON a.slot = b.slot AND a.city = b.city AND a.timezone = b.timezone
        GROUP BY 1, 2) d ON d.user_id = u.user_id AND d.community_id = c.community_id"""}


@query("p01_match_all_profiles", f"""
    SELECT e.user_id, e.tier, e.position, e.community_id, e.match_score, e.recent_activity, r.auto_joined_community,
           r.ai_intro_generated, length(p.text) AS text_chars
    FROM emitted e JOIN results r USING (user_id) JOIN ({TEXTS_SQL}) p USING (user_id)
    UNION ALL
    SELECT p.user_id, 'fallback', CAST(q.pos AS INTEGER), q.community_id, CAST(0 AS DOUBLE), q.recent_activity,
           CAST(NULL AS BIGINT), FALSE, length(p.text)
    FROM ({TEXTS_SQL}) p JOIN popular q ON TRUE WHERE p.user_id NOT IN (SELECT user_id FROM users)""")
def p01(v):
    results = matching.match_results(
        accepted_profiles(v), v.communities, v.index, v.activity, v.members, as_of(), v.toxicity,
        keep=["user_id", "embedding_text"], population=v.users, dim=DIM)
    flat = matching.explode_matches(
        results.withColumn("text_chars", F.length("embedding_text").cast("long")),
        "user_id", "tier", "auto_joined_community", "ai_intro_generated", "text_chars")
    return flat.drop("category", "member_count")


@query("p01_match_from_text", """
    SELECT user_id, tier, position, community_id, category, member_count, recent_activity, match_score FROM emitted""", **TEXT_VIEWS)
def p01_text(v):
    """Raw profiles to results with the default text vectors on both sides."""
    profiles = v.profiles.join(v.users.select("user_id", "city", "timezone"), "user_id", "left")
    described = v.communities.select("community_id", F.concat_ws(
        " ", "community_name", "category", "description").alias("embedding_text"))
    index = hooks.embed(described).select("community_id", "vector")
    results, _ = requests.match_profiles(
        profiles, v.communities, index, v.activity, v.members, v.users, as_of())
    return matching.explode_matches(results, "user_id", "tier")


@query("p02_decision", "SELECT user_id, tier, position, community_id, category, member_count, recent_activity, match_score FROM emitted")
def p02(v):
    return matching.explode_matches(decided(v), "user_id", "tier")


@query("p02_results", "SELECT user_id, tier, auto_joined_community, ai_intro_generated, requires_profile_update FROM results")
def p02_results(v):
    return matching.match_results(
        v.user_vectors, v.communities, v.index, v.activity, v.members, as_of(), v.toxicity,
        population=v.users, dim=DIM).drop("matches")


def greet(rows):
    """An introduction model: mentions the most active member; every tenth user's text is toxic, every
    thirteenth makes it fail."""
    out = []
    for row in rows:
        if row["user_id"] % 13 == 5:
            raise ValueError("no text")
        first = (row["active_members"] or [None])[0]
        out.append((f"{row['community_name']} welcomes you, says {first}", first, 0.9 if row["user_id"] % 10 == 1 else 0.2))
    return out


@query("p02_introductions", """
    SELECT t.user_id, t.auto_joined_community AS community_id, t.user_id % 13 = 5 AS model_failed,
           CASE WHEN t.user_id % 13 <> 5 THEN m.username END AS mentioned_member,
           CASE WHEN t.user_id % 13 = 5 THEN 'Welcome to Community#' || t.auto_joined_community || '! We''re excited to have you here.'
                ELSE 'Community#' || t.auto_joined_community || ' welcomes you, says ' || coalesce(m.username, 'None') END AS intro_text,
           t.user_id % 13 = 5 OR t.user_id % 10 <> 1 AS posted
    FROM tiers t LEFT JOIN members j ON j.user_id = t.user_id AND j.community_id = t.auto_joined_community
    LEFT JOIN (
      SELECT community_id, username FROM (
        SELECT m.community_id, u.username, u.user_id, count(a.message_id) AS n FROM users u JOIN members m USING (user_id)
        LEFT JOIN activity a ON a.user_id = u.user_id AND a.community_id = m.community_id
             AND a.created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n DESC, user_id) = 1) m ON m.community_id = t.auto_joined_community
    WHERE t.tier = 'soulmate' AND j.user_id IS NULL""")
def p02_introductions(v):
    existing = v.members.withColumnRenamed("community_id", "auto_joined_community")
    joining = settle(decided(v).filter(F.col("tier") == "soulmate").select("user_id", "auto_joined_community")
                     .join(existing, ["user_id", "auto_joined_community"], "left_anti"), "joining")
    return requests.introductions(joining, v.communities, v.activity, v.members, v.users, as_of(), greet).select(
        "user_id", F.col("auto_joined_community").alias("community_id"), "model_failed", "mentioned_member", "intro_text", "posted")


@query("p02_new_members", f"""
    SELECT t.user_id, t.auto_joined_community AS community_id, TIMESTAMP '{AS_OF}' AS joined_at, TRUE AS auto_joined
    FROM tiers t LEFT JOIN members m ON m.user_id = t.user_id AND m.community_id = t.auto_joined_community
    WHERE t.tier = 'soulmate' AND m.user_id IS NULL""")
def p02_new_members(v):
    return matching.new_memberships(decided(v), v.members, as_of())


@query("p03_no_candidate_fallback", """
    SELECT u.user_id, u.user_id % 4 = 0 AS moved, CASE WHEN u.user_id % 4 = 0 THEN 'fallback' ELSE t.tier END AS tier,
           count(*) AS n_matches, min(CASE WHEN u.user_id % 4 = 0 THEN p.pid ELSE e.community_id END) AS least_id
    FROM user_vectors u JOIN tiers t USING (user_id)
    LEFT JOIN emitted e ON e.user_id = u.user_id AND u.user_id % 4 <> 0
    LEFT JOIN (SELECT community_id AS pid FROM popular) p ON u.user_id % 4 = 0 GROUP BY 1, 2, 3""")
def p03(v):
    """Every fourth user has moved to a city without communities."""
    moved = v.user_vectors.withColumn("city", F.when(F.col("user_id") % 4 != 0, F.col("city")).otherwise("NOWHERE"))
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    popular = matching.popular_communities(v.communities, v.activity, as_of())
    out = matching.decide(matching.top_matches(moved, candidates, v.index, dim=DIM), popular)
    ids = F.transform("matches", lambda m: m["community_id"])
    return out.select("user_id", (F.col("user_id") % 4 == 0).alias("moved"), "tier",
                      F.size("matches").cast("long").alias("n_matches"), F.array_min(ids).alias("least_id"))


@query("p04_karma_profile", f"""
    SELECT user_id, karma_score, {tier_sql("karma_score")} AS tier, {label_sql("karma_score")} AS tier_label,
           {level_sql("karma_score")} AS tier_level, {next_sql("karma_score")} AS next_tier_threshold,
           CAST(coalesce(threshold, 0) AS INTEGER) AS inbox_shield_threshold, entries
    FROM karma LEFT JOIN shield USING (user_id) LEFT JOIN (
      SELECT user_id, string_agg(id || ':' || action_type, ',' ORDER BY rn) AS entries FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM ledger)
      WHERE rn <= 20 GROUP BY 1) USING (user_id)""")
def p04(v):
    text = F.transform("ledger", lambda e: F.concat(e["id"], F.lit(":"), e["action_type"]))
    return (ledger.profiles_with_page(v.users, v.ledger, v.shield)
            .withColumn("entries", F.array_join(text, ",")).drop("ledger"))


@query("p05_award_batch", f"""
    SELECT id, user_id, balance, {tier_sql("balance")} AS tier, {level_sql("balance")} AS tier_level,
           {next_sql("balance")} AS next_tier_threshold, inbox_shield_threshold FROM (
    SELECT id, user_id, CAST(run + coalesce(opening, 0) AS BIGINT) AS balance,
           CAST(coalesce(threshold, 0) AS INTEGER) AS inbox_shield_threshold
    FROM (SELECT *, CAST(sum(point_delta) OVER (PARTITION BY user_id ORDER BY created_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run
          FROM checked_awards WHERE reason IS NULL AND created_at >= TIMESTAMP '2024-01-10') LEFT JOIN shield USING (user_id)
    LEFT JOIN (SELECT user_id, sum(point_delta) AS opening FROM ledger WHERE created_at < TIMESTAMP '2024-01-10' GROUP BY 1)
          USING (user_id))""")
def p05(v):
    """Awards since a day, on top of the ledger before it."""
    late = F.col("created_at") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return ledger.award(v.award_requests.filter(late), v.users, v.ledger.filter(~late), v.shield).select(
        "id", "user_id", "balance", "tier", "tier_level", "next_tier_threshold", "inbox_shield_threshold")


@query("p05_award_steps", f"""
    SELECT id, user_id, CAST(run AS BIGINT) AS balance, {tier_sql("run")} AS tier,
           CAST(coalesce(threshold, 0) AS INTEGER) AS inbox_shield_threshold
    FROM (SELECT *, sum(point_delta) OVER (PARTITION BY user_id ORDER BY created_at, id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM checked_awards WHERE reason IS NULL)
    LEFT JOIN shield USING (user_id)""")
def p05_steps(v):
    """All awards in three steps, each on the totals that the one before has stored."""
    path = shared_dir(v.spark, "awards")
    days = F.dayofmonth("created_at")
    for step, (first, last) in enumerate(((1, 9), (10, 19), (20, 31))):
        ledger.award_step(v.award_requests.filter(days.between(first, last)), v.users, v.shield, path, step)
    return v.spark.read.parquet(f"{path}/awards").select("id", "user_id", "balance", "tier", "inbox_shield_threshold")


@query("p05_award_rejects", "SELECT id, reason FROM checked_awards WHERE reason IS NOT NULL")
def p05_rejects(v):
    return ledger.check_awards(v.award_requests, v.users).filter("reason IS NOT NULL").select("id", "reason")


@query("p06_message_eligibility", f"""
    SELECT e.pair_id, CASE WHEN pair_id % 29 = 3 THEN NULL ELSE allowed END AS allowed,
           CASE WHEN pair_id % 29 = 3 THEN 'forbidden' ELSE reason END AS reason FROM ({ELIGIBLE_SQL}) e""")
def p06(v):
    """Pairs asked for by someone other than the sender are refused before any lookup."""
    asked = v.pairs.withColumn("requester_id", F.when(
        F.col("pair_id") % 29 == 3, F.col("sender_id") + 1).otherwise(F.col("sender_id")))
    allowed, refused = V.split(asked, [V.self_only_rule(F.col("requester_id"), F.col("sender_id"))])
    checked = ledger.eligibility(allowed, ledger.scores(v.users, v.ledger), v.shield)
    return checked.select("pair_id", "allowed", "reason").unionByName(
        refused.select("pair_id", F.lit(None).cast("boolean").alias("allowed"), "reason"))


_BOTH = ", ".join(f"coalesce(n.{f}, c.{f}) AS {f}" for f in PREFERENCE_FIELDS)


@query("p07_preference_update", f"""
    SELECT *, ({ALL_FIELDS_SQL}) AS onboarding_complete FROM (
      SELECT coalesce(c.user_id, n.user_id) AS user_id, {_BOTH}
      FROM (SELECT user_id, {LATEST_FIELDS_SQL} FROM pref_patches WHERE created_at < TIMESTAMP '2024-01-16' GROUP BY 1) c
      FULL JOIN (SELECT user_id, {LATEST_FIELDS_SQL} FROM checked_patches
                 WHERE reason IS NULL AND created_at >= TIMESTAMP '2024-01-16' GROUP BY 1) n ON c.user_id = n.user_id)""")
def p07(v):
    stored, _ = stored_preferences(v)
    late = v.patch_requests.filter(F.col("created_at") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return preferences.update(late, v.users, stored, as_of()).drop("created_at", "updated_at")


@query("p07_preference_rejects", "SELECT seq, reason FROM checked_patches WHERE reason IS NOT NULL")
def p07_rejects(v):
    return preferences.check_patches(v.patch_requests, v.users).filter("reason IS NOT NULL").select("seq", "reason")


@query("p08_user_sync", SYNC_SQL.format(where="AND event_id % 97 <> 5"))
def p08(v):
    events = messages.parse_change_events(v.change_messages).withColumn("user_id", F.col("user_id").cast("long"))
    return users.sync(synced_users(v), events)
