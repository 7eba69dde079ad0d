"""Golden cases of matching: seed tables, diversity lists, tiers, decisions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import matching as M
from kindred.plans import matching
from tests.conftest import rows

# The sample communities (id, name, category, city, time zone, member count).
COMMUNITIES = [
    ("comm_py_sf_001", "Python Developers SF", "Programming", "San Francisco", "America/Los_Angeles", 1250),
    ("comm_ai_sf_001", "AI/ML Researchers SF", "AI", "San Francisco", "America/Los_Angeles", 890),
    ("comm_js_sf_001", "JavaScript Guild SF", "Programming", "San Francisco", "America/Los_Angeles", 1100),
    ("comm_ds_sf_001", "Data Science Hub SF", "Data Science", "San Francisco", "America/Los_Angeles", 1500),
    ("comm_game_sf_001", "SF Gaming Community", "Gaming", "San Francisco", "America/Los_Angeles", 3200),
    ("comm_web_ny_001", "Web Dev NYC", "Programming", "New York", "America/New_York", 2100),
    ("comm_ai_ny_001", "NYC AI Enthusiasts", "AI", "New York", "America/New_York", 750),
    ("comm_data_ny_001", "Data Science NYC", "Data Science", "New York", "America/New_York", 1800),
    ("comm_game_ny_001", "NYC Gamers", "Gaming", "New York", "America/New_York", 2500),
    ("comm_tech_aus_001", "Austin Tech Hub", "Programming", "Austin", "America/Chicago", 950),
    ("comm_startup_aus_001", "Austin Startups", "Business", "Austin", "America/Chicago", 1200),
    ("comm_py_sea_001", "Seattle Python Users", "Programming", "Seattle", "America/Los_Angeles", 880),
    ("comm_cloud_sea_001", "Cloud Engineers Seattle", "DevOps", "Seattle", "America/Los_Angeles", 1100),
    ("comm_general_001", "Tech Enthusiasts Global", "General", "San Francisco", "America/Los_Angeles", 5000),
    ("comm_general_002", "Programming 101", "Programming", "San Francisco", "America/Los_Angeles", 4500),
]
# The sample messages (community, user, hours ago).
MESSAGES = [
    ("comm_py_sf_001", "user_001", 24), ("comm_py_sf_001", "user_001", 48), ("comm_py_sf_001", "user_003", 72),
    ("comm_py_sf_001", "user_005", 96), ("comm_ai_sf_001", "user_001", 24), ("comm_ai_sf_001", "user_003", 120),
    ("comm_game_sf_001", "user_004", 1), ("comm_game_sf_001", "user_004", 6), ("comm_game_sf_001", "user_002", 24),
    ("comm_web_ny_001", "user_002", 48),
]


def now():
    return F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")



@pytest.fixture(scope="module")
def communities(spark):
    return spark.createDataFrame(
        COMMUNITIES, "community_id string, community_name string, category string, city string, timezone string, member_count int"
    ).withColumn("is_active", F.lit(True)).cache()


@pytest.fixture(scope="module")
def activity(spark):
    df = spark.createDataFrame([(f"msg_{i + 1:03d}", *m) for i, m in enumerate(MESSAGES)],
                               "message_id string, community_id string, user_id string, hours int")
    return df.withColumn("created_at", now() - F.make_dt_interval(hours=F.col("hours"))).drop("hours").cache()


def test_popular_on_the_samples(communities, activity):
    got = [r.community_name for r in matching.popular_communities(communities, activity, now()).collect()]
    assert got == ["Tech Enthusiasts Global", "Programming 101", "SF Gaming Community", "NYC Gamers", "Web Dev NYC"]


def test_all_sample_messages_are_recent(activity):
    assert matching.recent_rows(activity, now()).count() == 10
    assert matching.recent_rows(activity, now(), days=5).count() == 10  # inclusive at exactly five days
    assert matching.recent_rows(activity, now(), days=4).count() == 9


def test_report_counts(communities, activity):
    got = {r.community_id: r.recent_activity for r in matching.with_recent_activity(communities, activity, now()).collect()}
    assert got["comm_py_sf_001"] == 4 and got["comm_game_sf_001"] == 3 and got["comm_tech_aus_001"] == 0


def test_silent_sorts_before_active_on_equal_members(spark, communities, activity):
    tied = communities.withColumn("member_count", F.lit(7))
    first = [r.community_id for r in matching.popular_communities(tied, activity, now(), 15).collect()]
    assert set(first[-4:]) == {"comm_py_sf_001", "comm_ai_sf_001", "comm_game_sf_001", "comm_web_ny_001"}
    assert first[-4] == "comm_py_sf_001"


def test_candidate_cap(communities, activity):
    got = matching.location_candidates(communities, activity, now(), cap=2)
    sf = [r.community_id for r in got.filter("city = 'San Francisco'").orderBy("candidate_rank").collect()]
    assert sf == ["comm_general_001", "comm_general_002"]
    assert got.count() == 2 + 2 + 2 + 2


def as_array(spark, lists):
    data = [(u, [(i, c, float(s)) for i, c, s in items]) for u, items in lists]
    return spark.createDataFrame(data, "user_id int, matches array<struct<community_id:int,category:string,match_score:double>>")


def test_diversity_lists(spark):
    same = [(1, "Programming", .95), (2, "Programming", .92), (3, "Programming", .89), (4, "Gaming", .86), (5, "Programming", .84)]
    mixed = [(1, "Programming", .95), (2, "Gaming", .92), (3, "Art", .89)]
    df = as_array(spark, [(1, same), (2, mixed), (3, [])])
    got = {r.user_id: [m.community_id for m in r.m] for r in df.select("user_id", M.diversify("matches").alias("m")).collect()}
    assert got == {1: [1, 2, 4, 3, 5], 2: [1, 2, 3], 3: []}


def moved(categories):
    """List move, step by step."""
    items = list(enumerate(categories))
    if len(items) >= 4 and len({c for _, c in items[:3]}) == 1:
        for i in range(3, len(items)):
            if items[i][1] != items[0][1]:
                items.insert(2, items.pop(i))
                break
    return [i for i, _ in items]


def test_diversity_array_and_window_forms_equal_a_list_move(spark):
    rng = random.Random(11)
    lists = [(u, [(i, rng.choice("aaab"), 1 - i / 100) for i in range(rng.randint(0, 20))]) for u in range(1500)]
    df = as_array(spark, lists)
    want = {u: moved([c for _, c, _ in items]) for u, items in lists}
    arrays = {r.user_id: [m.community_id for m in r.m] for r in df.select("user_id", M.diversify("matches").alias("m")).collect()}
    assert arrays == want
    long = df.select("user_id", F.posexplode("matches").alias("p", "m")).select(
        "user_id", (F.col("p") + 1).alias("rn"), "m.community_id", "m.category")
    ranked = {}
    for r in matching.diversity_ranks(long).orderBy("user_id", "new_rank").collect():
        ranked.setdefault(r.user_id, []).append(r.community_id)
    assert ranked == {u: ids for u, ids in want.items() if ids}


@pytest.mark.parametrize("score,tier", [(None, "fallback"), (0.0, "fallback"), (0.5499, "fallback"), (0.55, "explorer"),
                                        (0.87, "explorer"), (0.8701, "soulmate"), (1.0, "soulmate")])
def test_match_tier(spark, score, tier):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(M.match_tier(F.col("s"))).first()[0] == tier


def test_toxicity_gate_and_model_flag_disagree_at_the_limit(spark):
    df = spark.createDataFrame([(0.7499,), (0.75,), (0.7501,)], "t double")
    assert rows(df.select(M.postable(F.col("t")), M.model_approved(F.col("t")))) == [(False, False), (False, True), (True, True)]


def test_results_end_to_end(spark, communities, activity):
    ids = [c[0] for c in COMMUNITIES]
    index = spark.createDataFrame([(cid, [1.0 if i == j else 0.0 for j in range(15)]) for i, cid in enumerate(ids)],
                                  "community_id string, vector array<float>")

    def toward(**weights):
        return [float(weights.get(cid, 0.0)) for cid in ids]

    users = spark.createDataFrame([
        ("soul", "San Francisco", "America/Los_Angeles", toward(comm_py_sf_001=1.0)),
        ("member", "San Francisco", "America/Los_Angeles", toward(comm_py_sf_001=1.0)),
        ("toxic", "San Francisco", "America/Los_Angeles", toward(comm_ai_sf_001=1.0)),
        ("explore", "New York", "America/New_York", toward(comm_web_ny_001=1.0, comm_ai_ny_001=0.9)),
        ("vague", "Austin", "America/Chicago", toward(comm_py_sf_001=1.0)),
        ("lost", "Atlantis", "America/Chicago", toward(comm_py_sf_001=1.0)),
    ], "user_id string, city string, timezone string, vector array<double>")
    members = spark.createDataFrame([("member", "comm_py_sf_001")], "user_id string, community_id string")
    toxicity = spark.createDataFrame([("toxic", 0.75)], "user_id string, score double")
    out = {r.user_id: r for r in matching.match_results(
        users, communities, index, activity, members, now(), toxicity, dim=15).collect()}
    assert [m.community_id for m in out["soul"].matches] == ["comm_py_sf_001"]
    assert (out["soul"].tier, out["soul"].auto_joined_community, out["soul"].ai_intro_generated) == ("soulmate", "comm_py_sf_001", True)
    assert (out["member"].auto_joined_community, out["member"].ai_intro_generated) == ("comm_py_sf_001", False)
    assert (out["toxic"].tier, out["toxic"].ai_intro_generated) == ("soulmate", False)
    assert out["explore"].tier == "explorer" and len(out["explore"].matches) == 4
    assert out["explore"].matches[0].community_id == "comm_web_ny_001"
    for name in ("vague", "lost"):
        assert out[name].tier == "fallback" and out[name].requires_profile_update
        assert [m.member_count for m in out[name].matches] == [5000, 4500, 3200, 2500, 2100]
        assert {m.match_score for m in out[name].matches} == {0.0}


def test_decide_survives_no_popular_community(spark, communities, activity):
    users = spark.createDataFrame([(1, [])], "user_id int, matches array<struct<community_id:string,"
                                  "community_name:string,category:string,member_count:int,recent_activity:bigint,match_score:double>>")
    none = matching.popular_communities(communities.filter("false"), activity, now())
    row = matching.decide(users, none).first()
    assert row.tier == "fallback" and row.matches == []


def test_insert_if_absent(spark):
    have = spark.createDataFrame([(1, 1), (1, 2)], "user_id int, community_id int")
    new = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 1)], "user_id int, community_id int")
    assert rows(matching.insert_if_absent(have, new, ["user_id", "community_id"])) == [(1, 3), (2, 1)]
