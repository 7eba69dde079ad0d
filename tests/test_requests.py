"""Raw profiles to results, with default and custom hooks."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kindred import hooks
from kindred.plans import requests
from tests.conftest import rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACE = ("San Francisco", "America/Los_Angeles")


@pytest.fixture(scope="module")
def world(spark):
    communities = spark.createDataFrame([
        ("py", "Python Circle", "Programming", *PLACE, 10, "python code people", True),
        ("ml", "Learning Lab", "AI", *PLACE, 20, "neural networks and learning", True),
        ("ga", "Game Night", "Gaming", *PLACE, 30, None, True),
    ], "community_id string, community_name string, category string, city string, timezone string, member_count int, description string, is_active boolean")
    activity = spark.createDataFrame([("m1", "py", "old", "2024-01-10 00:00:00")], "message_id string, community_id string, user_id string, at string"
                                     ).withColumn("created_at", F.to_timestamp_ntz("at")).drop("at")
    members = spark.createDataFrame([("old", "py")], "user_id string, community_id string")
    users = spark.createDataFrame([("old", "olga"), ("a", "ann"), ("b", "bob")], "user_id string, username string")
    profiles = spark.createDataFrame([
        ("a", "  I write python code with people, mail a@b.org  ", ["Python", " python "], *PLACE),
        ("b", "neural networks", ["x"], "Atlantis", "UTC"),
        ("short", "hi", ["x"], *PLACE),
        ("tagless", "a long enough biography", [], *PLACE),
    ], "user_id string, bio string, interest_tags array<string>, city string, timezone string")
    return communities, activity, members, users, profiles, F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")


def keyword_vectors(texts):
    words = ["python", "neural", "game"]
    return np.array([[float(w in t.lower()) for w in words] for t in texts])


def test_prepare(world):
    cleaned, rejected = requests.prepare(world[4])
    assert rows(rejected, "user_id", "reason") == [("short", "bio too short"), ("tagless", "tag count")]
    row = cleaned.filter("user_id = 'a'").first()
    assert row.embedding_text == "Bio: I write python code with people, mail [email removed]\nInterests: programming, python"
    assert row.pii_removed


def match(world, **fns):
    communities, activity, members, users, profiles, now = world
    text = communities.select("community_id", F.concat_ws(" ", "community_name", "description").alias("embedding_text"))
    index = hooks.embed(text, batch_fn=keyword_vectors).select("community_id", "vector")
    results, rejected = requests.match_profiles(
        profiles, communities, index, activity, members, users, now, embed_fn=keyword_vectors, dim=3, **fns)
    assert rejected.count() == 2
    return {r.user_id: r for r in results.collect()}


def test_custom_vectors(world):
    got = match(world)
    assert set(got) == {"a", "b"}
    assert (got["a"].tier, got["a"].auto_joined_community, got["a"].ai_intro_generated) == ("soulmate", "py", True)
    assert got["a"].intro_text.startswith("Welcome to Python Circle!") and got["a"].mentioned_member is None
    assert got["a"].created_at is not None
    assert got["b"].tier == "fallback" and [m.community_id for m in got["b"].matches] == ["ga", "ml", "py"]


def test_introduction_hook_sees_members_and_gates_on_toxicity(world):
    seen = match(world, intro_fn=lambda batch: [
        (f"Hi {r['community_name']}, meet {r['active_members'][0]}", r["active_members"][0], 0.1) for r in batch])
    assert (seen["a"].intro_text, seen["a"].mentioned_member, seen["a"].ai_intro_generated) == (
        "Hi Python Circle, meet olga", "olga", True)
    assert seen["b"].intro_text is None
    long = match(world, intro_fn=lambda batch: [("w" * 400, None, 0.1) for _ in batch])
    assert long["a"].ai_intro_generated and len(long["a"].intro_text) == 400
    toxic = match(world, intro_fn=lambda batch: [("bad words", None, 0.75) for _ in batch])
    assert toxic["a"].ai_intro_generated is False and toxic["a"].auto_joined_community == "py"
    broken = match(world, intro_fn=lambda batch: 1 / 0)
    assert broken["a"].intro_text.startswith("Welcome to Python Circle!") and broken["a"].ai_intro_generated


def test_default_vectors_run(world):
    communities, activity, members, users, profiles, now = world
    index = hooks.embed(communities.select("community_id", F.col("community_name").alias("embedding_text"))).select("community_id", "vector")
    results, _ = requests.match_profiles(profiles, communities, index, activity, members, users, now)
    assert results.count() == 2


@pytest.mark.parametrize("with_intro", [False, True])
def test_the_embedding_model_runs_once_per_valid_profile(spark, world, with_intro):
    communities, activity, members, users, profiles, now = world
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return keyword_vectors(texts)

    index = hooks.embed(communities.select("community_id", F.col("community_name").alias("embedding_text")), batch_fn=keyword_vectors)
    results, _ = requests.match_profiles(
        profiles, communities, index.select("community_id", "vector"), activity, members, users, now, embed_fn=counted, dim=3,
        intro_fn=(lambda batch: [("hi", None, 0.0) for _ in batch]) if with_intro else None)
    results.write.format("noop").mode("overwrite").save()
    assert calls.value == 2


def test_request_id_travels_with_the_result(world):
    profiles = world[4].withColumn("request_id", F.concat(F.lit("r-"), "user_id"))
    got = match((*world[:4], profiles, world[5]))
    assert {r.request_id for r in got.values()} == {"r-a", "r-b"}


def test_fresh_vectors_are_reused_and_stale_ones_replaced(spark, world):
    now = world[5]
    cached = spark.createDataFrame([
        ("user", "a", "set", "2024-01-08 00:00:00", 1, [0.0, 0.0, 1.0]), ("user", "b", "set", "2024-01-01 00:00:00", 2, [9.0, 9.0, 9.0]),
        ("group", "a", "set", "2024-01-11 00:00:00", 3, [5.0, 5.0, 5.0])],
        "kind string, key string, op string, at string, seq long, vector array<float>").withColumn("ts", F.to_timestamp_ntz("at")).drop("at")
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return keyword_vectors(texts)

    cleaned, _ = requests.prepare(world[4])
    got = {r.user_id: r.vector for r in requests.user_vectors(cleaned, now, counted, 3, cached).collect()}
    assert calls.value == 1 and got == {"a": [0.0, 0.0, 1.0], "b": [0.0, 1.0, 0.0]}
    removed = cached.unionByName(spark.createDataFrame(
        [("user", "a", "invalidate", 4, None)], "kind string, key string, op string, seq long, vector array<float>").withColumn("ts", now))
    again = {r.user_id: r.vector for r in requests.user_vectors(cleaned, now, keyword_vectors, 3, removed).collect()}
    assert again["a"] == [1.0, 0.0, 0.0]
    writes = requests.cache_writes(requests.user_vectors(cleaned, now, keyword_vectors, 3), now, F.lit(9).cast("long"))
    stored = requests.user_vectors(cleaned, now, lambda texts: 1 / 0, 3, cached.unionByName(writes.select(cached.columns)))
    assert stored.count() == 2
