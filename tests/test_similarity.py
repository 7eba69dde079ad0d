"""Block similarity search against brute force."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.vectors import cosine
from kindred.operators import similarity
from kindred.operators.similarity import top_k_by_cosine, vector_rejects

FIELDS = ["community_id", "category"]


def unit_cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    places = [("A", "x"), ("A", "y"), ("B", "x")]
    communities = [(i, f"c{i % 3}", *places[i % 3], vec()) for i in range(60)]
    communities[10] = (10, "c1", *places[1], communities[7][4])  # exact tie with 7
    communities[9] = (9, "c0", *places[0], None)                 # absent from the index
    users = []
    for i in range(400):
        place = places[0] if rng.random() < 0.6 else rng.choice([*places, ("NOWHERE", "x"), (None, "x"), ("A", None)])
        users.append((i, *place, vec()))
    users[0] = (0, "A", "x", [0.0] * 8)
    users[1] = (1, "A", "x", None)
    users[2] = (2, "A", "y", list(communities[7][4]))
    u = spark.createDataFrame(users, "user_id long, city string, timezone string, vector array<double>")
    c = spark.createDataFrame(communities, "community_id long, category string, city string, timezone string, vector array<double>")
    return users, communities, u, c


def expected(users, communities, k):
    want = {}
    for uid, city, tz, vector in users:
        scored = []
        if city and tz and vector:
            for cid, _, c_city, c_tz, cv in communities:
                if (c_city, c_tz) == (city, tz) and cv:
                    scored.append((-round(unit_cos(np.array(vector), np.array(cv)), 12), cid))
        want[uid] = [(cid, round(-s, 6)) for s, cid in sorted(scored)[:k]]
    return want


@pytest.mark.parametrize("block_rows", [10, 100, 100_000])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_equals_brute_force(data, k, block_rows):
    users, communities, u, c = data
    got = top_k_by_cosine(u, c.drop("vector"), c.select("community_id", "vector"), 8, fields=FIELDS, k=k, block_rows=block_rows)
    found = {r.user_id: [(m.community_id, round(m.match_score, 6)) for m in r.matches] for r in got.collect()}
    assert found == expected(users, communities, k)


def test_hot_location_is_cut_into_blocks(data, spark):
    _, _, u, c = data
    got = top_k_by_cosine(u, c.drop("vector"), c.select("community_id", "vector"), 8, fields=FIELDS, k=3, block_rows=20)
    assert got.count() == u.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("bad", [[], [1.0, 2.0, 3.0], [float("nan")] * 8, [None] * 8, None])
def test_a_bad_vector_changes_nobody_elses_matches(spark, data, bad):
    """Also on the lowest id of a location, where it once set the size for all others."""
    _, _, u, c = data
    index = c.select("community_id", "vector")
    spoiled = index.withColumn("vector", F.when(F.col("community_id") == 0, F.lit(bad).cast("array<double>")).otherwise(F.col("vector")))

    def matches(vectors, without=None):
        got = top_k_by_cosine(u, c.drop("vector"), vectors, 8, fields=FIELDS, k=60)
        return {r.user_id: [m.community_id for m in r.matches if m.community_id != without] for r in got.collect()}
    assert matches(spoiled) == matches(index, without=0)


def test_rejects_name_the_reason(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, [])],
                               "id int, vector array<double>")
    got = {r.id: r.reason for r in vector_rejects(df, 2).collect()}
    assert got == {2: "wrong size", 3: "no vector", 4: "not finite", 5: "not finite", 6: "wrong size"}


def test_keeps_named_user_columns(data):
    _, _, u, c = data
    tagged = u.withColumn("note", F.concat(F.lit("n"), "user_id"))
    got = top_k_by_cosine(tagged, c.drop("vector"), c.select("community_id", "vector"), 8, fields=FIELDS, k=2,
                          keep=["user_id", "note"], population=u)
    assert got.columns == ["user_id", "note", "matches"]
    assert got.filter("note <> concat('n', user_id)").count() == 0


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [round(r[0], 9) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0]


def test_scores_held_at_once_are_bounded():
    """A full block of users against a full location: 4,096 x 1,000 scores at once took four times this memory."""
    rng = np.random.default_rng(3)
    users = pa.table({"user_id": range(8192), "vector": list(rng.normal(size=(8192, 64)))})
    groups = pa.table({"id": range(1000), "vector": list(rng.normal(size=(1000, 64)))})
    score = similarity._scorer(20, 64, ["user_id"], "id", ["id"])
    tracemalloc.start()
    found = score(users, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 8192 and peak < 40_000_000
