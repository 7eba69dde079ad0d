"""Joins (J01-J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import DIM, SINCE, as_of, query
from kindred.functions.karma import levels_may_chat
from kindred.operators.lookups import lookup, restrict
from kindred.plans import delivery, ledger, matching, users
from kindred.operators import vector_index
from kindred.operators.similarity import top_k_by_cosine, vector_rejects
from kindred.session import shared_dir
from kindred.sources import tables


@query("j01_activity_left_join", """
    SELECT community_id, member_count, message_count, recent_activity FROM scored_communities""")
def j01(v):
    return matching.with_recent_activity(v.communities, v.activity, as_of()).select(
        "community_id", "member_count", "message_count", "recent_activity")


@query("j02_users_members", "SELECT user_id, username, community_id FROM users JOIN members USING (user_id)")
def j02(v):
    return v.users.select("user_id", "username").join(v.members, "user_id")


def stored_by_user(v, df, name):
    """The table stored in buckets of its user, under a name of its own."""
    path = shared_dir(v.spark, name)
    return tables.save_bucketed(df, path.rsplit("/", 1)[-1].replace("-", "_"), path, "user_id", 8)


@query("j02_bucketed_members", """
    SELECT user_id, count(*) AS communities, CAST(sum(message_count) AS BIGINT) AS messages
    FROM users JOIN members USING (user_id) JOIN (SELECT user_id, count(*) AS message_count FROM activity GROUP BY 1) USING (user_id)
    GROUP BY 1""")
def j02_bucketed(v):
    """Users, members and activity stored by user: joined and counted where they lie."""
    people, members, activity = (stored_by_user(v, df, name) for df, name in (
        (v.users, "users"), (v.members, "members"), (v.activity.select("user_id", "message_id"), "activity")))
    sent = activity.groupBy("user_id").agg(F.count(F.lit(1)).alias("message_count"))
    return people.select("user_id").join(members, "user_id").join(sent, "user_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("communities"), F.sum("message_count").alias("messages"))


@query("j03_left_join_on_predicates", f"""
    SELECT m.community_id, u.user_id, count(a.message_id) AS message_count
    FROM users u JOIN members m USING (user_id)
    LEFT JOIN activity a ON a.user_id = u.user_id AND a.community_id = m.community_id AND a.created_at >= {SINCE}
    GROUP BY 1, 2""")
def j03(v):
    counts = matching.message_counts(v.activity, as_of(), ("community_id", "user_id"))
    return (v.members.join(v.users.select("user_id"), "user_id")
            .join(counts, ["community_id", "user_id"], "left")
            .select("community_id", "user_id", F.coalesce("message_count", F.lit(0)).alias("message_count")))


@query("j04_activity_report", f"""
    SELECT c.city, c.category, count(DISTINCT c.community_id) AS n_communities, count(a.message_id) AS recent_messages
    FROM communities c LEFT JOIN activity a ON c.community_id = a.community_id AND a.created_at >= {SINCE}
    GROUP BY 1, 2""")
def j04(v):
    """Report by city and category; communities and their groups stay without any message."""
    counted = matching.with_recent_activity(v.communities, v.activity, as_of())
    return counted.groupBy("city", "category").agg(
        F.count(F.lit(1)).alias("n_communities"), F.sum("recent_activity").alias("recent_messages"))


@query("j05_detail_merge", """
    SELECT h.user_id, c.community_id, c.category, c.member_count, h.match_score
    FROM (SELECT user_id, CASE WHEN community_id % 8 = 5 THEN 1000000 ELSE 0 END + community_id AS community_id,
                 round(score, 6) AS match_score FROM ranked) h
    JOIN communities c USING (community_id)""")
def j05(v):
    """All scored hits with their details; every eighth community has lost its detail row."""
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    top = top_k_by_cosine(v.user_vectors, candidates, v.index, DIM, population=v.users)
    hits = top.select("user_id", F.inline("matches")).select("user_id", F.when(
        F.col("community_id") % 8 == 5, F.col("community_id") + 1_000_000).otherwise(F.col("community_id")).alias("community_id"),
        F.round("match_score", 6).alias("match_score"))
    return hits.join(v.communities.select("community_id", "category", "member_count"), "community_id")


@query("j06_similarity_join", """
    SELECT user_id, community_id, CAST(rn AS INTEGER) AS rank, round(score, 6) AS score FROM ranked""")
def j06(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    top = top_k_by_cosine(v.user_vectors, candidates, v.index, DIM, population=v.users)
    return top.select("user_id", F.posexplode("matches").alias("p", "m")).select(
        "user_id", "m.community_id", (F.col("p") + 1).alias("rank"),
        F.round("m.match_score", 6).alias("score"))


@query("j06_cell_search", """
    SELECT user_id, community_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, community_id) AS INTEGER) AS rank,
           round(score, 6) AS score
    FROM (SELECT u.user_id, c.community_id, round(list_cosine_similarity(u.vector, CAST(c.vector AS DOUBLE[])), 12) AS score
          FROM user_vectors u JOIN communities c USING (city, timezone))
    QUALIFY rank <= 20""")
def j06_cells(v):
    """All communities of a location, without a cap, through a stored index of cells."""
    path = shared_dir(v.spark, "cells")
    vector_index.build(v.communities.select("community_id", "city", "timezone"), v.index, DIM, path, ["community_id"])
    top = vector_index.search(v.spark, v.user_vectors, path, DIM, ["community_id"], exact=True)
    return top.select("user_id", F.posexplode("matches").alias("p", "m")).select(
        "user_id", "m.community_id", (F.col("p") + 1).alias("rank"), F.round("m.match_score", 6).alias("score"))


def misfits(v):
    """The index with unusable vectors: cut short on the lowest ids, empty, missing or not finite elsewhere."""
    i, x = F.col("community_id"), F.col("vector")
    return v.index.withColumn("vector", F.when(i < 25, F.slice(x, 1, 3)).when(i % 50 == 26, F.lit(None))
                              .when(i % 50 == 27, F.slice(x, 1, 0))
                              .when(i % 50 == 28, F.transform(x, lambda y, at: F.when(at == 2, F.lit("NaN").cast("float")).otherwise(y)))
                              .otherwise(x))


@query("j06_vector_rejects", """
    SELECT 'index' AS side, vec_id AS id, CASE WHEN vec_id >= 25 AND vec_id % 50 = 26 THEN 'no vector'
           WHEN vec_id < 25 OR vec_id % 50 = 27 THEN 'wrong size' ELSE 'not finite' END AS reason
    FROM embeddings WHERE vec_id < 25 OR vec_id % 50 IN (26, 27, 28)
    UNION ALL SELECT 'user', user_id, 'wrong size' FROM user_vectors WHERE user_id % 9 = 4""")
def j06_rejects(v):
    users = v.user_vectors.withColumn("vector", F.when(F.col("user_id") % 9 == 4, F.array(F.lit(1.0))).otherwise(F.col("vector")))
    return vector_rejects(misfits(v), DIM).select(F.lit("index").alias("side"), F.col("community_id").alias("id"), "reason").unionByName(
        vector_rejects(users, DIM).select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "reason"))


@query("j06_misfits_change_nobody_else", """
    SELECT user_id, community_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, community_id) AS INTEGER) AS rank,
           round(score, 6) AS score FROM sims WHERE NOT (community_id < 25 OR community_id % 50 IN (26, 27, 28))
    QUALIFY rank <= 20""")
def j06_misfits(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    top = top_k_by_cosine(v.user_vectors, candidates, misfits(v), DIM, population=v.users)
    return top.select("user_id", F.posexplode("matches").alias("p", "m")).select(
        "user_id", "m.community_id", (F.col("p") + 1).alias("rank"), F.round("m.match_score", 6).alias("score"))


@query("j07_id_semi_join", """
    SELECT community_id, category FROM communities WHERE community_id IN (SELECT community_id FROM candidates)""")
def j07(v):
    allowed = matching.location_candidates(v.communities, v.activity, as_of())
    return restrict(v.communities, allowed, "community_id").select("community_id", "category")


@query("j08_insert_if_absent", """
    SELECT i.user_id, i.community_id FROM
      (SELECT DISTINCT user_id, (community_id + user_id % 3) % 100 AS community_id FROM activity) i
    LEFT JOIN members m ON m.user_id = i.user_id AND m.community_id = i.community_id WHERE m.user_id IS NULL""")
def j08(v):
    incoming = v.activity.select(
        "user_id", ((F.col("community_id") + F.col("user_id") % 3) % 100).alias("community_id"))
    return matching.insert_if_absent(v.members, incoming, ["user_id", "community_id"])


@query("j09_pair_lookup", """
    SELECT p.pair_id, CAST(coalesce(s.karma_score, 0) AS BIGINT) AS sender_score,
           CAST(coalesce(t.karma_score, 0) AS BIGINT) AS target_score, CAST(coalesce(h.threshold, 0) AS INTEGER) AS target_inbox_shield
    FROM pairs p LEFT JOIN karma s ON s.user_id = p.sender_id LEFT JOIN karma t ON t.user_id = p.target_id
    LEFT JOIN shield h ON h.user_id = p.target_id""")
def j09(v):
    return ledger.pair_scores(v.pairs, ledger.scores(v.users, v.ledger), v.shield).drop("sender_id", "target_id")


@query("j10_description_default", """
    SELECT a.message_id, coalesce(c.description, '') AS description FROM activity a LEFT JOIN communities c USING (community_id)""")
def j10(v):
    details = v.communities.select("community_id", "description")
    return lookup(v.activity, details, "community_id", {"description": F.lit("")}).select("message_id", "description")


@query("j11_cascade_delete", """
    SELECT 'activity' AS child, message_id AS id FROM activity
    WHERE community_id NOT IN (SELECT community_id FROM communities WHERE NOT is_active)
    UNION ALL SELECT 'ledger', id FROM ledger WHERE user_id NOT IN (SELECT user_id FROM users WHERE NOT is_active)""")
def j11(v):
    closed, gone = v.communities.filter("NOT is_active"), v.users.filter("NOT is_active")
    kept = users.cascade_delete(v.activity, closed, "community_id", "community_id")
    entries = users.cascade_delete(v.ledger, gone, "user_id", "user_id")
    return kept.select(F.lit("activity").alias("child"), F.col("message_id").alias("id")).unionByName(
        entries.select(F.lit("ledger").alias("child"), "id"))


@query("j12_delivery_fan_out", """
    SELECT r.user_id, l.sid, r.karma_score FROM karma r JOIN live l USING (user_id)""")
def j12(v):
    return delivery.fan_out(ledger.scores(v.users, v.ledger), delivery.live_connections(v.connections)).select(
        "user_id", "sid", "karma_score")


@query("j13_chat_tier_range", """
    SELECT pair_id, coalesce(s.lvl, 0) AS sender_level, coalesce(t.lvl, 0) AS target_level,
           abs(coalesce(s.lvl, 0) - coalesce(t.lvl, 0)) <= 1 AS may_chat
    FROM pairs LEFT JOIN (SELECT user_id, %s AS lvl FROM karma) s ON s.user_id = sender_id
    LEFT JOIN (SELECT user_id, %s AS lvl FROM karma) t ON t.user_id = target_id""" % (
    ("CAST(CASE WHEN karma_score >= 1000 THEN 4 WHEN karma_score >= 500 THEN 3 WHEN karma_score >= 300 THEN 2 "
     "WHEN karma_score >= 100 THEN 1 ELSE 0 END AS INTEGER)",) * 2))
def j13(v):
    levels = ledger.with_tier(ledger.scores(v.users, v.ledger)).select("user_id", "tier_level")
    s = levels.select(F.col("user_id").alias("sender_id"), F.col("tier_level").alias("sender_level"))
    t = levels.select(F.col("user_id").alias("target_id"), F.col("tier_level").alias("target_level"))
    known = v.pairs.join(s, "sender_id", "left").join(t, "target_id", "left").fillna(0, ["sender_level", "target_level"])
    return (known.select("pair_id", "sender_level", "target_level",
                    levels_may_chat(F.col("sender_level"), F.col("target_level")).alias("may_chat")))
