"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.catalog.base import DIM, ALL_FIELDS_SQL, LATEST_FIELDS_SQL, SINCE, as_of, query
from kindred.hooks import max_score
from kindred.operators.similarity import top_k_by_cosine
from kindred.plans import delivery, ledger, matching, preferences


@query("a01_recent_counts", "SELECT community_id, message_count FROM recent")
def a01(v):
    return matching.message_counts(v.activity, as_of())


@query("a02_count_nullable", f"""
    SELECT c.community_id, count(a.message_id) AS recent_messages, count(a.user_id) AS recent_rows FROM communities c
    LEFT JOIN (SELECT community_id, user_id, CASE WHEN message_id % 7 <> 3 THEN message_id END AS message_id
               FROM activity WHERE created_at >= {SINCE}) a USING (community_id) GROUP BY 1""")
def a02(v):
    """Messages that lost their id do not count; a community without any counts 0."""
    recent = matching.recent_rows(v.activity, as_of()).withColumn(
        "message_id", F.when(F.col("message_id") % 7 != 3, F.col("message_id")))
    counts = recent.groupBy("community_id").agg(
        F.count("message_id").alias("recent_messages"), F.count("user_id").alias("recent_rows"))
    return v.communities.select("community_id").join(counts, "community_id", "left").fillna(0)


@query("a03_table_counts", """
    SELECT (SELECT count(*) FROM communities) AS communities, (SELECT count(*) FROM users) AS members_total,
           (SELECT count(*) FROM events) AS messages""")
def a03(v):
    """Counts of three tables: one partial count per task, then one row."""
    def tagged(df, name):
        return df.select(F.lit(name).alias("t"))
    both = tagged(v.communities, "c").union(tagged(v.users, "u")).union(tagged(v.activity, "a"))
    return both.agg(F.count_if(F.col("t") == "c").alias("communities"),
                    F.count_if(F.col("t") == "u").alias("members_total"),
                    F.count_if(F.col("t") == "a").alias("messages"))


@query("a04_karma_score", "SELECT user_id, karma_score FROM karma")
def a04(v):
    return ledger.scores(v.users, v.ledger)


@query("a05_top3_one_category", """
    SELECT user_id, count(DISTINCT category) = 1 AS uniform FROM ranked WHERE rn <= 3 GROUP BY 1""")
def a05(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    top = top_k_by_cosine(v.user_vectors, candidates, v.index, DIM, k=3, population=v.users)
    names = F.array_distinct(F.transform("matches", lambda m: m["category"]))
    return top.filter(F.size("matches") > 0).select("user_id", (F.size(names) == 1).alias("uniform"))


@query("a06_toxicity_max", """
    SELECT event_id, greatest(value / 100, (user_id % 100) / 100.0::DOUBLE, (event_id % 97) / 100.0::DOUBLE, 0.05::DOUBLE) AS toxicity
    FROM events""")
def a06(v):
    scored = v.events.select(
        "event_id", (F.col("value") / 100).alias("hate"), (F.col("user_id") % 100 / 100.0).alias("harassment"),
        (F.col("event_id") % 97 / 100.0).alias("violence"), F.lit(0.05).alias("sexual"))
    return scored.select("event_id", max_score().alias("toxicity"))


@query("a07_onboarding_complete", f"""
    SELECT user_id, ({ALL_FIELDS_SQL}) AS onboarding_complete FROM (SELECT user_id, {LATEST_FIELDS_SQL} FROM pref_patches GROUP BY 1)""")
def a07(v):
    return preferences.fold(v.pref_patches).select("user_id", "onboarding_complete")


@query("a08_ordered_matches", """
    SELECT user_id, string_agg(CAST(community_id AS VARCHAR), ',' ORDER BY new_rank) AS community_ids, count(*) AS n FROM reranked GROUP BY 1""")
def a08(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    top = matching.top_matches(v.user_vectors, candidates, v.index, dim=DIM, population=v.users).filter(F.size("matches") > 0)
    ids = F.transform("matches", lambda m: m["community_id"].cast("string"))
    return top.select("user_id", F.array_join(ids, ",").alias("community_ids"),
                      F.size("matches").cast("long").alias("n"))


@query("a09_ledger_list", """
    SELECT u.user_id, p.entries FROM users u LEFT JOIN (
      SELECT user_id, string_agg(id || ':' || point_delta, ',' ORDER BY rn) AS entries FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM ledger)
      WHERE rn <= 20 GROUP BY 1) p USING (user_id)""")
def a09(v):
    profile = ledger.profiles_with_page(v.users, v.ledger, v.shield)
    text = F.transform("ledger", lambda e: F.concat(e["id"], F.lit(":"), e["point_delta"]))
    return profile.select("user_id", F.array_join(text, ",").alias("entries"))


@query("a10_live_connections", "SELECT user_id, sid FROM live")
def a10(v):
    return delivery.live_connections(v.connections)


@query("a10_connection_counts", "SELECT user_id, count(*) AS n_connections FROM live GROUP BY 1")
def a10_counts(v):
    return delivery.connection_counts(delivery.live_connections(v.connections))


