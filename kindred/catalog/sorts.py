"""Sorts, limits, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.catalog.base import DIM, POPULARITY_SQL, as_of, query
from kindred.plans import ledger, matching


@query("k01_null_first_sort", f"""
    SELECT category, community_id, CAST(rn AS INTEGER) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY category, city ORDER BY {POPULARITY_SQL}) AS rn FROM scored_communities)""")
def k01(v):
    """The sort rule as positions within a category and city, all of them."""
    scored = matching.with_recent_activity(v.communities, v.activity, as_of())
    position = F.row_number().over(Window.partitionBy("category", "city").orderBy(*matching.popularity_order()))
    return scored.select("category", "community_id", position.alias("rn"))


@query("k02_popular_communities", """
    SELECT community_id, community_name, category, member_count, recent_activity FROM popular""")
def k02(v):
    return matching.popular_communities(v.communities, v.activity, as_of()).select(
        "community_id", "community_name", "category", "member_count", "recent_activity")


@query("k02_popular_endpoint", f"""
    SELECT community_id, member_count, recent_activity FROM scored_communities WHERE is_active
    ORDER BY {POPULARITY_SQL} LIMIT 10""")
def k02_endpoint(v):
    return matching.popular_communities(v.communities, v.activity, as_of(), 10).select(
        "community_id", "member_count", "recent_activity")


@query("k03_city_report", """
    SELECT community_name, category, city, member_count, recent_activity AS recent_messages
    FROM scored_communities ORDER BY city, category, community_id LIMIT 10""")
def k03(v):
    return (matching.with_recent_activity(v.communities, v.activity, as_of())
            .orderBy("city", "category", "community_id").limit(10)
            .select("community_name", "category", "city", "member_count",
                    F.col("recent_activity").alias("recent_messages")))


@query("k04_head_slice", """
    SELECT user_id, community_id, new_rank AS position FROM reranked WHERE new_rank <= 5""")
def k04(v):
    candidates = matching.location_candidates(v.communities, v.activity, as_of())
    head = matching.top_matches(v.user_vectors, candidates, v.index, dim=DIM, population=v.users).withColumn("matches", F.slice("matches", 1, 5))
    return matching.explode_matches(head, "user_id").select("user_id", "community_id", "position")


@query("k05_leaderboard", "SELECT user_id, karma_score FROM karma ORDER BY karma_score DESC, user_id LIMIT 100")
def k05(v):
    return ledger.leaderboard(ledger.scores(v.users, v.ledger), 100)


@query("k05_rank_of_user", """
    SELECT user_id, karma_score, row_number() OVER (ORDER BY karma_score DESC, user_id) AS position FROM karma""")
def k05_rank(v):
    return ledger.standings(ledger.scores(v.users, v.ledger))


@query("k05_leaderboard_page", """
    SELECT user_id, karma_score, position FROM (
      SELECT *, row_number() OVER (ORDER BY karma_score DESC, user_id) AS position FROM karma) WHERE position BETWEEN 101 AND 120""")
def k05_page(v):
    return ledger.standings(ledger.scores(v.users, v.ledger)).filter(F.col("position").between(101, 120))
