"""Preference patches: the validation cases, folding, upsert."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.operators import validation as V
from kindred.plans import preferences as P
from kindred.schemas import PREFERENCE_CHOICES, PREFERENCE_FIELDS
from tests.conftest import rows

FULL = {"location": "Mumbai", **{f: values[0] for f, values in PREFERENCE_CHOICES.items()}}
SCHEMA = "seq int, requester_id string, user_id string, created_at timestamp_ntz, " + ", ".join(
    f"{f} string" for f in PREFERENCE_FIELDS)


def patches(spark, items):
    """items: (requester, user, {field: value})"""
    raw = [(i, r, u, f"2024-01-01 00:{i:02d}:00", *[p.get(f) for f in PREFERENCE_FIELDS])
           for i, (r, u, p) in enumerate(items)]
    df = spark.createDataFrame(raw, SCHEMA.replace("timestamp_ntz", "string"))
    return df.withColumn("created_at", F.to_timestamp_ntz("created_at"))


@pytest.mark.parametrize("patch,reason", [
    (FULL, None),
    ({"location": "  New Delhi  "}, None),
    ({"natural_rhythm": "Party all night"}, "natural_rhythm not a choice"),
    ({}, "empty patch"),
    ({"location": "A"}, "location length"),
    ({"location": " A \t"}, "location length"),
    ({"location": "x" * 100}, None),
    ({"location": "x" * 101}, "location length"),
    ({"background_vibe": "Absolute silence"}, None),
])
def test_patch_rules(spark, patch, reason):
    df = V.with_reason(patches(spark, [("u", "u", patch)]), V.patch_rules())
    assert df.first().reason == reason


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([("a", True), ("b", True), ("off", False)], "user_id string, is_active boolean")


def test_check_order_and_guards(spark, users):
    df = patches(spark, [("a", "a", {"location": "  Pune "}), ("b", "a", {"location": "Pune"}), ("off", "off", {"location": "Pune"}),
                         ("ghost", "ghost", {"location": "Pune"}), ("x", "a", {})])
    got = P.check_patches(df, users)
    assert rows(got, "seq", "reason") == [(0, None), (1, "forbidden"), (2, "not found"), (3, "not found"), (4, "empty patch")]
    assert got.filter("seq = 0").first().location == "Pune"


def test_fold_keeps_latest_non_null(spark):
    steps = [("a", "a", {"location": "Pune"}), ("a", "a", {"natural_rhythm": "Night owl"}), ("a", "a", {"location": "Goa"})]
    row = P.fold(patches(spark, steps)).first()
    assert (row.location, row.natural_rhythm, row.onboarding_complete) == ("Goa", "Night owl", False)


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_history_flag_flips_at_the_last_field(spark, hot_rows):
    steps = [("a", "a", {f: v}) for f, v in FULL.items()] + [("a", "a", {"location": "Goa"})]
    got = P.history(patches(spark, steps), hot_rows=hot_rows).orderBy("seq").collect()
    assert [r.onboarding_complete for r in got] == [False] * 6 + [True, True]
    assert [r.cur_location for r in got] == ["Mumbai"] * 7 + ["Goa"]


def test_parts_fold_to_the_same_state(spark):
    steps = [("a", "a", {"location": "Pune"}), ("b", "b", {"location": "Goa"}), ("a", "a", {"location": "Agra"}),
             ("a", "a", {"weekend_env": "Cozy coffee shop"})]
    df = patches(spark, steps)
    parts = P.fold_parts(df.filter("seq >= 2")).unionByName(P.fold_parts(df.filter("seq < 2")))
    columns = ["user_id", *PREFERENCE_FIELDS, "onboarding_complete"]
    assert rows(P.merge_parts(parts), *columns) == rows(P.fold(df), *columns)


def test_upsert_touches_only_what_it_updates(spark, users):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    stored = P.fold(patches(spark, [("a", "a", {"location": "Pune", "weekend_env": "Cozy coffee shop"}), ("b", "b", {"location": "Goa"})])
                    ).withColumnsRenamed({"first_patch_at": "created_at", "last_patch_at": "updated_at"})
    new = patches(spark, [("a", "a", {"location": "Agra"}), ("b", "a", {"location": "Bad"})])
    got = {r.user_id: r for r in P.update(new, users, stored, as_of).collect()}
    assert (got["a"].location, got["a"].weekend_env) == ("Agra", "Cozy coffee shop")
    assert str(got["a"].updated_at).startswith("2024-02-01") and str(got["a"].created_at).startswith("2024-01-01")
    assert str(got["b"].updated_at).startswith("2024-01-01") and got["b"].location == "Goa"
