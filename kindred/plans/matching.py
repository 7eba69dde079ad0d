"""Community matching for all users of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import matching as M
from kindred.operators.similarity import top_k_by_cosine
from kindred.operators.skew import top_k_per_key
from kindred.schemas import (
    ACTIVITY_DAYS, CANDIDATE_CAP, EMIT_EXPLORER, EXPLORER, FALLBACK, INTRO_MEMBERS, POPULAR_K,
    SOULMATE, TOP_K, VECTOR_DIM)


def since(as_of: Column, days: int = ACTIVITY_DAYS) -> Column:
    return as_of - F.expr(f"INTERVAL {days} DAYS")


def recent_rows(activity: DataFrame, as_of: Column, days: int = ACTIVITY_DAYS) -> DataFrame:
    """Rows of the trailing window; the lower bound is inclusive, there is no upper bound.

    A table laid out by day (``entry_date``) is also pruned to the window's days.
    """
    recent = activity.filter(F.col("created_at") >= since(as_of, days))
    if "entry_date" in activity.columns:
        recent = recent.filter(F.col("entry_date") >= F.to_date(since(as_of, days)))
    return recent


def message_counts(activity: DataFrame, as_of: Column, by: tuple[str, ...] = ("community_id",)) -> DataFrame:
    return recent_rows(activity, as_of).groupBy(*by).agg(F.count(F.lit(1)).alias("message_count"))


def with_recent_activity(communities: DataFrame, activity: DataFrame, as_of: Column) -> DataFrame:
    """Every community, its raw 7-day count (null if silent) and the count defaulted to 0."""
    counts = message_counts(activity, as_of)
    return (communities.join(counts, "community_id", "left")
            .withColumn("recent_activity", F.coalesce("message_count", F.lit(0))))


def popularity_order() -> list[Column]:
    """Both keys descending with nulls first (a silent community sorts before an active one)."""
    return [F.desc_nulls_first("member_count"), F.desc_nulls_first("message_count"),
            F.asc("community_id")]


def popular_communities(
    communities: DataFrame, activity: DataFrame, as_of: Column, limit: int = POPULAR_K,
) -> DataFrame:
    return (with_recent_activity(communities.filter("is_active"), activity, as_of)
            .orderBy(*popularity_order()).limit(limit))


def location_candidates(
    communities: DataFrame, activity: DataFrame, as_of: Column, cap: int = CANDIDATE_CAP,
) -> DataFrame:
    """Active communities per (city, timezone), at most ``cap`` of each by popularity."""
    scored = with_recent_activity(communities.filter("is_active"), activity, as_of)
    return top_k_per_key(scored, ["city", "timezone"], popularity_order(), cap,
                         rank="candidate_rank", salt_on=["community_id"])


def top_matches(
    users: DataFrame, candidates: DataFrame, index: DataFrame, k: int = TOP_K, dim: int = VECTOR_DIM, **options,
) -> DataFrame:
    """user_id and the ranked, diversity-adjusted ``matches`` array."""
    ranked = top_k_by_cosine(users, candidates, index, dim, k=k, **options)
    return ranked.withColumn("matches", M.diversify("matches"))


def diversity_ranks(ranked: DataFrame, user: str = "user_id", rank: str = "rn") -> DataFrame:
    """The diversity move on long-form lists (one row per match): adds ``new_rank``.

    Equal to :func:`kindred.functions.matching.diversify` on arrays; windows hold one user's list.
    """
    w = Window.partitionBy(user)
    head = F.max(F.when(F.col(rank) == 1, F.col("category"))).over(w)
    flagged = ranked.withColumn("_head", head)
    other = F.col("category") != F.col("_head")
    flagged = (flagged
               .withColumn("_n", F.count(F.lit(1)).over(w))
               .withColumn("_mixed", F.max((F.col(rank) <= 3) & other).over(w))
               .withColumn("_first", F.min(F.when((F.col(rank) >= 4) & other, F.col(rank))).over(w)))
    applies = (F.col("_n") >= 4) & ~F.col("_mixed") & F.col("_first").isNotNull()
    return flagged.withColumn(
        "new_rank",
        F.when(applies & (F.col(rank) == F.col("_first")), F.lit(3))
        .when(applies & F.col(rank).between(F.lit(3), F.col("_first") - 1), F.col(rank) + 1)
        .otherwise(F.col(rank)),
    ).drop("_head", "_n", "_mixed", "_first")


def active_members(
    users: DataFrame, members: DataFrame, activity: DataFrame, as_of: Column, k: int = INTRO_MEMBERS,
) -> DataFrame:
    """Per community its k most active members of the last 7 days (silent members count 0)."""
    counts = message_counts(activity, as_of, ("community_id", "user_id"))
    joined = (members.select("community_id", "user_id")
              .join(users.select("user_id", "username"), "user_id")
              .join(counts, ["community_id", "user_id"], "left")
              .withColumn("message_count", F.coalesce("message_count", F.lit(0))))
    return top_k_per_key(joined, ["community_id"], [F.desc("message_count"), F.asc("user_id")], k)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def decide(matches: DataFrame, popular: DataFrame) -> DataFrame:
    """Tier and emitted list per user, from ``matches`` and the few popular communities.

    The first ``POPULAR_K`` of the popular list are folded into one row and attached to the fallback
    users by an equi-join on the tier.
    """
    top = F.get("matches", F.lit(0))["match_score"]
    decided = matches.withColumn("tier", M.match_tier(top))
    match_type = matches.schema["matches"].dataType.simpleString()
    popular = popular.orderBy(*popularity_order()).limit(POPULAR_K)
    listed = popular.withColumn("pos", F.row_number().over(Window.orderBy(*popularity_order())))
    fallback = listed.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "pos", "community_id", "community_name", "category", "member_count",
                "recent_activity"))),
            lambda p: F.struct(p["community_id"], p["community_name"], p["category"],
                               p["member_count"], p["recent_activity"], F.lit(0.0)),
        ).cast(match_type).alias("popular"),
        F.max(F.lit(FALLBACK)).alias("tier"))
    clamped = F.transform(F.col("shown"), lambda m: m.withField(
        "match_score", M.clamp_score(m["match_score"])))
    return (decided.join(F.broadcast(fallback), "tier", "left")
            .withColumn("shown", F.when(F.col("tier") == SOULMATE, F.slice("matches", 1, 1))
                        .when(F.col("tier") == EXPLORER, F.slice("matches", 1, EMIT_EXPLORER))
                        .otherwise(F.coalesce("popular", F.array().cast(match_type))))
            .withColumn("matches", clamped)
            .withColumn("auto_joined_community", F.when(
                F.col("tier") == SOULMATE, F.col("matches")[0]["community_id"]))
            .withColumn("requires_profile_update", F.col("tier") == FALLBACK)
            .drop("shown", "popular"))


def new_memberships(results: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """The membership rows that the auto-joins of ``results`` add: none for users already in the group."""
    joining = results.filter(F.col("auto_joined_community").isNotNull()).select(
        "user_id", F.col("auto_joined_community").alias("community_id"))
    new = insert_if_absent(members, joining, ["user_id", "community_id"])
    return new.withColumn("joined_at", as_of).withColumn("auto_joined", F.lit(True))


def match_against(
    users: DataFrame,
    candidates: DataFrame,
    popular: DataFrame,
    index: DataFrame,
    members: DataFrame,
    toxicity: DataFrame | None = None,
    k: int = TOP_K,
    keep: list[str] | None = None,
    population: DataFrame | None = None,
    dim: int = VECTOR_DIM,
) -> DataFrame:
    """One match result per user: tier, emitted matches, auto-join, intro flag.

    ``candidates`` and ``popular`` may be plans (recomputed on use) or settled tables.
    """
    decided = decide(top_matches(users, candidates, index, k, dim, keep=keep, population=population), popular)
    member = members.select(
        "user_id", F.col("community_id").alias("auto_joined_community"), F.lit(True).alias("_member"))
    out = decided.join(member, ["user_id", "auto_joined_community"], "left")
    score = F.lit(0.0)
    if toxicity is not None:
        out = out.join(toxicity.select("user_id", F.col("score").alias("_toxicity")), "user_id", "left")
        score = F.coalesce(F.col("_toxicity"), F.lit(0.0))
    return (out.withColumn("ai_intro_generated",
                           (F.col("tier") == SOULMATE) & F.col("_member").isNull() & M.postable(score))
            .drop("_member", "_toxicity"))


def match_results(
    users: DataFrame, communities: DataFrame, index: DataFrame, activity: DataFrame, members: DataFrame,
    as_of: Column, toxicity: DataFrame | None = None, cap: int = CANDIDATE_CAP, **options,
) -> DataFrame:
    """:func:`match_against` the candidates and popular communities as of a moment."""
    candidates = location_candidates(communities, activity, as_of, cap)
    popular = popular_communities(communities, activity, as_of)
    return match_against(users, candidates, popular, index, members, toxicity, **options)


def explode_matches(results: DataFrame, *columns: str) -> DataFrame:
    """One row per emitted match with its 1-based ``position``."""
    return results.select(*columns, F.posexplode("matches").alias("_pos", "_m")).select(
        *columns, (F.col("_pos") + 1).alias("position"), F.col("_m.community_id").alias("community_id"),
        F.col("_m.category").alias("category"), F.round("_m.match_score", 6).alias("match_score"),
        F.col("_m.member_count").alias("member_count"),
        F.col("_m.recent_activity").alias("recent_activity"))
