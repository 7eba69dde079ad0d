"""Golden cases of the points ledger."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.functions import karma as K
from kindred.plans import ledger as L
from kindred.schemas import KARMA_ACTIONS, tier_unlocks
from tests.conftest import rows

BOUNDARIES = [
    (0, None, 0, 100), (50, None, 0, 100), (99, None, 0, 100), (100, "beginner", 1, 300), (299, "beginner", 1, 300),
    (300, "pathfinder", 2, 500), (499, "pathfinder", 2, 500), (500, "explorer", 3, 1000), (999, "explorer", 3, 1000),
    (1000, "conqueror", 4, None), (5000, "conqueror", 4, None), (-30, None, 0, 100),
]


@pytest.mark.parametrize("score,tier,level,following", BOUNDARIES)
def test_boundaries(spark, score, tier, level, following):
    s = F.col("s")
    row = spark.createDataFrame([(score,)], "s int").select(
        K.tier(s), K.tier_level(s), K.next_threshold(s), K.tier_label(s)).first()
    assert tuple(row) == (tier, level, following, tier.capitalize() if tier else None)


@pytest.mark.parametrize("action,delta,reason", [
    ("NO_SHOW_PENALTY", 10, "penalty must be negative"), ("EVENT_RSVP", -5, "reward must be positive"),
    ("ADMIN_ADJUSTMENT", -50, None), ("ADMIN_ADJUSTMENT", 50, None), ("NO_SHOW_PENALTY", 0, None),
    ("EVENT_RSVP", 0, None), ("HOST_CANCEL_PENALTY", -1, None), ("BONUS", 5, "unknown action"),
    (None, 5, "unknown action"), ("EVENT_RSVP", None, "missing delta"),
])
def test_sign_rule(spark, action, delta, reason):
    df = spark.createDataFrame([(action, delta)], "a string, d int")
    assert df.select(K.award_rejection(F.col("a"), F.col("d"))).first()[0] == reason


def entries(spark, data):
    df = spark.createDataFrame(
        [(i, u, a, d, r, s) for i, (u, a, d, r, s) in enumerate(data)],
        "id long, user_id string, action_type string, point_delta int, reference_id string, at string")
    return df.withColumn("created_at", F.to_timestamp_ntz("at")).drop("at")


def day(d, h=0, m=0):
    return f"2024-03-{d:02d} {h:02d}:{m:02d}:00"


@pytest.fixture(scope="module")
def journey(spark):
    onboarding = [("SIGNUP_EMAIL_VERIFY", 20), ("SIGNUP_PROFILE_PHOTO", 30), ("SIGNUP_VIBE_QUESTIONS", 30), ("SIGNUP_CLAIM_ID", 20)]
    later = [("EVENT_RSVP", 10), ("GPS_CHECKIN", 25), ("EVENT_PHOTO_POST", 15), ("PEER_ENDORSEMENT", 20), ("NO_SHOW_PENALTY", -10)]
    return entries(spark, [("u", a, d, "e1", day(1, i)) for i, (a, d) in enumerate(onboarding + later)])


def test_onboarding_reaches_beginner(spark, journey):
    users = spark.createDataFrame([("u",), ("idle",)], "user_id string")
    first = journey.filter("id < 4")
    scored = L.with_tier(L.scores(users, first))
    assert rows(scored, "user_id", "karma_score", "tier") == [("idle", 0, None), ("u", 100, "beginner")]


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_running_balance(journey, hot_rows):
    got = [r.balance for r in L.running_balance(journey, hot_rows=hot_rows).orderBy("id").collect()]
    assert got == [20, 50, 80, 100, 110, 135, 150, 170, 160]


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_caps(spark, hot_rows):
    data = [("u", "EVENT_RSVP", 10, "e", day(1, h)) for h in range(5)]             # 3 per day
    data += [("u", "EVENT_RSVP", 10, "e", day(2, 0))]
    data += [("u", "GPS_CHECKIN", 25, r, day(1, 9)) for r in ("e1", "e1", "e2", None, None)]  # 1 per event
    data += [("u", "EVENT_PHOTO_POST", 15, "e1", day(1, 10 + i)) for i in range(3)]  # 2 per event
    data += [("u", "SIGNUP_CLAIM_ID", 20, None, day(d)) for d in (1, 5)]             # once
    data += [("u", "PEER_ENDORSEMENT", 20, "e1", day(1, h)) for h in range(4)]       # no cap
    data += [("v", "SIGNUP_CLAIM_ID", 20, None, day(1)), ("u", "NO_SHOW_PENALTY", -10, None, day(1))]
    got = [r.earned for r in L.apply_caps(entries(spark, data), hot_rows=hot_rows).orderBy("id").collect()]
    assert got == [10, 10, 10, 0, 0, 10, 25, 0, 25, 25, 25, 15, 15, 0, 20, 0, 20, 20, 20, 20, 20, -10]


def test_award_batch_rejects_and_pays(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    shields = spark.createDataFrame([("a", 200)], "user_id string, threshold int")
    requests = entries(spark, [("a", "SIGNUP_CLAIM_ID", 120, None, day(1)), ("ghost", "SIGNUP_CLAIM_ID", 20, None, day(1)),
                               ("b", "NO_SHOW_PENALTY", 10, None, day(1)), ("a", "NO_SHOW_PENALTY", -30, None, day(2))])
    assert rows(L.check_awards(requests, users), "id", "reason") == [
        (0, None), (1, "unknown user"), (2, "penalty must be negative"), (3, None)]
    none = requests.filter("id < 0")
    assert rows(L.award(requests, users, none, shields), "id", "balance", "tier", "inbox_shield_threshold") == [
        (0, 120, "beginner", 200), (3, 90, None, 200)]


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_awards_go_on_from_the_existing_ledger(spark, journey, hot_rows):
    users = spark.createDataFrame([("u",)], "user_id string")
    shields = spark.createDataFrame([("u", 50)], "user_id string, threshold int")
    first, later = journey.filter("id < 4"), journey.filter("id >= 4")
    got = L.award(first, users, later.filter("id < 0"), shields, hot_rows=hot_rows)
    assert [r.balance for r in got.orderBy("id").collect()][-1] == 100
    got = L.award(later, users, first, shields, hot_rows=hot_rows).orderBy("id").collect()
    assert [r.balance for r in got] == [110, 135, 150, 170, 160] and {r.tier for r in got} == {"beginner"}


def test_page_size_is_checked(spark, journey):
    shields = spark.createDataFrame([("u", 50)], "user_id string, threshold int")
    for limit, offset in ((0, 0), (101, 0), (10, -1)):
        with pytest.raises(ValueError):
            L.profiles_with_page(shields.select("user_id"), journey, shields, limit, offset)


def test_eligibility(spark):
    scores = spark.createDataFrame([("low", 50), ("mid", 200), ("top", 900)], "user_id string, karma_score long")
    shields = spark.createDataFrame([("low", 300), ("mid", 0)], "user_id string, threshold int")
    pairs = spark.createDataFrame(
        [(1, "low", "mid"), (2, "mid", "low"), (3, "top", "low"), (4, "mid", "mid"), (5, "ghost", "mid"), (6, "mid", "ghost"), (7, "low", "low")],
        "pair_id int, sender_id string, target_id string")
    got = {r.pair_id: r for r in L.eligibility(pairs, scores, shields).collect()}
    assert [got[i].allowed for i in range(1, 8)] == [False, False, True, True, False, True, False]
    assert got[1].reason == ("Your karma (50) is below the recipient's karma (200). "
                             "You can only message users with equal or lower karma.")
    assert got[2].reason == "The recipient's inbox shield requires a minimum karma of 300. Your karma is 200."
    assert got[3].reason is None and got[6].target_score == 0 and got[6].target_inbox_shield == 0


def test_unlocks_accumulate_by_level(spark):
    profile = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4)], "user_id string, tier_level int")
    got = L.unlocks(profile, tier_unlocks(spark)).groupBy("user_id").count()
    assert rows(got) == [("b", 3), ("c", 9)]


def test_profile_page_is_ordered_and_bounded(spark, journey):
    users = spark.createDataFrame([("u",), ("idle",)], "user_id string")
    shields = spark.createDataFrame([("u", 10)], "user_id string, threshold int")
    got = {r.user_id: r for r in L.profiles_with_page(users, journey, shields, limit=3, offset=1).collect()}
    assert [e.id for e in got["u"].ledger] == [7, 6, 5]
    assert got["idle"].ledger is None and got["u"].karma_score == 160


def test_leaderboard(spark):
    scores = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", -1)], "user_id string, karma_score long")
    assert [r.user_id for r in L.leaderboard(scores, 3).collect()] == ["b", "c", "a"]


def test_thirteen_actions():
    assert len(KARMA_ACTIONS) == len(set(KARMA_ACTIONS)) == 13
