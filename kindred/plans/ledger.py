"""Points ledger: scores, pages, running balances, caps, messaging rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import karma as K
from kindred.operators.ranking import with_position
from kindred.operators.skew import page_per_key, running_by_key
from kindred.operators.validation import reject_if
from kindred.schemas import AWARD_RULES, PAGE_LIMIT
from kindred.session import settle
from kindred.sources import tables


def scores(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """user_id, karma_score of every user (0 without ledger rows; may be negative)."""
    sums = ledger.groupBy("user_id").agg(F.sum("point_delta").alias("_sum"))
    return users.select("user_id").join(sums, "user_id", "left").select(
        "user_id", F.coalesce("_sum", F.lit(0)).cast("long").alias("karma_score"))


def with_tier(df: DataFrame, score: str = "karma_score") -> DataFrame:
    s = F.col(score)
    return (df.withColumn("tier", K.tier(s)).withColumn("tier_label", K.tier_label(s))
            .withColumn("tier_level", K.tier_level(s))
            .withColumn("next_tier_threshold", K.next_threshold(s)))


def with_shield(df: DataFrame, shields: DataFrame) -> DataFrame:
    return (df.join(shields.select("user_id", F.col("threshold").alias("_t")), "user_id", "left")
            .withColumn("inbox_shield_threshold", F.coalesce("_t", F.lit(0))).drop("_t"))


def profiles(users: DataFrame, ledger: DataFrame, shields: DataFrame) -> DataFrame:
    return with_shield(with_tier(scores(users, ledger)), shields)


def ledger_page(ledger: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return page_per_key(ledger, "user_id", "created_at", "id", limit, offset)


def profiles_with_page(
    users: DataFrame, ledger: DataFrame, shields: DataFrame, limit: int = 20, offset: int = 0,
) -> DataFrame:
    """Profiles with the page as an ordered array of at most ``limit`` (1 to 100) entries."""
    if not 1 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"a page has 1 to {PAGE_LIMIT} entries and a non-negative offset")
    entry = F.struct("rn", "id", "action_type", "point_delta", "reference_id", "created_at")
    pages = (ledger_page(ledger, limit, offset).groupBy("user_id")
             .agg(F.array_sort(F.collect_list(entry)).alias("ledger")))
    return profiles(users, ledger, shields).join(pages, "user_id", "left")


def running_balance(ledger: DataFrame, **options) -> DataFrame:
    """Each award with the score and tier right after it."""
    out = running_by_key(ledger, ["user_id"], "created_at", "id",
                         sums={"balance": F.col("point_delta").cast("long")}, **options)
    return out.withColumn("tier", K.tier(F.col("balance")))


def cap_scope(action: Column, created_at: Column, reference: Column, row: Column) -> Column:
    """What an action's cap counts within: one day, one event, or everything.

    An award that names no event cannot be held against another one: it is a scope of its own.
    """
    scope = F.lit(None).cast("string")
    for name, _, _, kind in AWARD_RULES:
        if kind is None:
            continue
        value = {"once": F.lit("once"),
                 "day": F.date_format(created_at, "yyyy-MM-dd"),
                 "reference": F.coalesce(F.concat(F.lit("event "), reference.cast("string")),
                                        F.concat(F.lit("row "), row.cast("string")))}[kind]
        scope = F.when(action == name, value).otherwise(scope)
    return scope


def cap_of(action: Column) -> Column:
    cap = F.lit(None).cast("int")
    for name, _, limit, _ in AWARD_RULES:
        if limit is not None:
            cap = F.when(action == name, F.lit(limit)).otherwise(cap)
    return cap


def apply_caps(ledger: DataFrame, **options) -> DataFrame:
    """``earned`` = the delta, or 0 for awards beyond their action's cap. Keeps every row."""
    capped = (ledger.withColumn("_scope", cap_scope(
                  F.col("action_type"), F.col("created_at"), F.col("reference_id"), F.col("id")))
              .withColumn("_cap", cap_of(F.col("action_type"))))
    limited = running_by_key(
        capped.filter(F.col("_cap").isNotNull()), ["user_id", "action_type", "_scope"],
        "created_at", "id", sums={"_nth": F.lit(1)}, **options)
    limited = limited.withColumn(
        "earned", F.when(F.col("_nth") <= F.col("_cap"), F.col("point_delta")).otherwise(F.lit(0)))
    free = capped.filter(F.col("_cap").isNull()).withColumn("earned", F.col("point_delta"))
    return limited.drop("_nth").unionByName(free).drop("_scope", "_cap")


def check_awards(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Award requests with ``reason``: bad action, bad sign, or unknown user; null = accepted."""
    known = users.select("user_id", F.lit(True).alias("_known"))
    return (requests.join(known, "user_id", "left")
            .withColumn("reason", F.coalesce(
                K.award_rejection(F.col("action_type"), F.col("point_delta")),
                reject_if(F.col("_known").isNull(), "unknown user")))
            .drop("_known"))


def award(
    requests: DataFrame, users: DataFrame, ledger: DataFrame, shields: DataFrame, opening: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Accepted awards, each with the profile that results from it on top of the existing ledger.

    The rows to append are the accepted ones; ``balance`` is the user's whole score after each. ``opening`` (user_id,
    balance) stands for the ledger where totals are stored (:func:`award_step`); without it the ledger of the
    requests' users is added up.
    """
    accepted = check_awards(requests, users).filter(F.col("reason").isNull()).drop("reason")
    if opening is None:
        asked = requests.select("user_id").distinct()
        opening = ledger.join(asked, "user_id", "left_semi").groupBy("user_id").agg(
            F.sum("point_delta").cast("long").alias("balance"))
    opening = opening.select("user_id", F.col("balance").alias("_opening"))
    # The requests bound the rows per user, so hot users are counted without the checks.
    balances = running_balance(accepted, population=requests, **options).drop("tier")
    whole = (balances.join(opening, "user_id", "left")
             .withColumn("balance", F.col("balance") + F.coalesce("_opening", F.lit(0))).drop("_opening"))
    return with_shield(with_tier(whole, "balance"), shields)


TOTALS = "user_id long, balance long, awards long, step long"


def stored_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals that the steps so far have left under ``path``: one row per user and step that touched the user."""
    return tables.read_or_empty(spark, f"{path}/totals", TOTALS)


def last_totals(totals: DataFrame) -> DataFrame:
    """``user_id``, ``balance`` and number of ``awards`` after each user's last step."""
    last = totals.groupBy("user_id").agg(F.max_by(F.struct("balance", "awards"), "step").alias("_t"))
    return last.select("user_id", "_t.balance", "_t.awards")


def award_step(
    requests: DataFrame, users: DataFrame, shields: DataFrame, path: str, step: int, **options,
) -> DataFrame:
    """Apply one batch of awards on top of the stored totals; the awards with their balances, as written.

    Steps come in order, and the awards of a step count as later than those of the steps before. A step reads its own
    users' last totals and no awards of earlier steps. It writes its awards (``awards``) and its users' new totals
    (``totals``) as partition ``step=<n>``, which a repetition of the step overwrites; :func:`fold_totals` keeps the
    totals at one row per user.
    """
    spark = requests.sparkSession
    asked = requests.select("user_id").distinct()
    before = stored_totals(spark, path).filter(F.col("step") < step).join(asked, "user_id", "left_semi")
    opening = settle(last_totals(before), "opening")
    done = award(requests, users, None, shields, opening=opening, **options)
    tables.overwrite_partition(done, f"{path}/awards", "step", step)
    awards = spark.read.parquet(f"{path}/awards").filter(F.col("step") == step).drop("step")
    new = awards.groupBy("user_id").agg(F.sum("point_delta").cast("long").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    totals = new.join(opening, "user_id", "left").select(
        "user_id", (F.coalesce("balance", F.lit(0)) + F.col("_sum")).cast("long").alias("balance"),
        (F.coalesce("awards", F.lit(0)) + F.col("_n")).cast("long").alias("awards"))
    tables.overwrite_partition(totals, f"{path}/totals", "step", step)
    return awards


def fold_totals(spark: SparkSession, path: str, folded: str) -> None:
    """Write the totals as one row per user, under the step that left it, to a new place."""
    totals = stored_totals(spark, path)
    last = totals.groupBy("user_id").agg(F.max_by(F.struct("balance", "awards", "step"), "step").alias("_t"))
    last.select("user_id", "_t.*").write.partitionBy("step").parquet(f"{folded}/totals")


def pair_scores(pairs: DataFrame, score_table: DataFrame, shields: DataFrame) -> DataFrame:
    """Both sides of (sender_id, target_id) looked up; a missing side counts 0."""
    sender = score_table.select(F.col("user_id").alias("sender_id"), F.col("karma_score").alias("_s"))
    target = with_shield(score_table, shields).select(
        F.col("user_id").alias("target_id"), F.col("karma_score").alias("_t"),
        F.col("inbox_shield_threshold").alias("_h"))
    return (pairs.join(sender, "sender_id", "left").join(target, "target_id", "left")
            .withColumn("sender_score", F.coalesce("_s", F.lit(0)))
            .withColumn("target_score", F.coalesce("_t", F.lit(0)))
            .withColumn("target_inbox_shield", F.coalesce("_h", F.lit(0)))
            .drop("_s", "_t", "_h"))


def eligibility(pairs: DataFrame, score_table: DataFrame, shields: DataFrame) -> DataFrame:
    args = [F.col("sender_score"), F.col("target_score"), F.col("target_inbox_shield")]
    return (pair_scores(pairs, score_table, shields)
            .withColumn("allowed", K.message_allowed(*args))
            .withColumn("reason", K.message_refusal(*args)))


def unlocks(profile: DataFrame, unlock_table: DataFrame) -> DataFrame:
    """One row per user and feature unlocked at or below the user's level.

    The level is spread over 1..level first, so the match is an equi-join on the few levels.
    """
    reached = profile.filter("tier_level >= 1").withColumn(
        "level", F.explode(F.sequence(F.lit(1), F.col("tier_level"))))
    return reached.join(unlock_table, "level")


def standings(score_table: DataFrame) -> DataFrame:
    """Every user with its ``position`` by score, equal scores by id: any user's place and any page by a filter."""
    return with_position(score_table, [F.desc("karma_score"), F.asc("user_id")])


def leaderboard(score_table: DataFrame, n: int) -> DataFrame:
    return score_table.orderBy(F.desc("karma_score"), F.asc("user_id")).limit(n)
