"""Change events: parsing, folding, upsert, soft delete, cascade, shields."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kindred.plans import users as U
from kindred.sources import messages
from tests.conftest import rows

PAYLOAD = {"id": "user_1", "email_addresses": [{"email_address": "a@example.com", "id": "e1"}, {"email_address": "b@example.com", "id": "e2"}],
           "first_name": "Ada", "last_name": None, "public_metadata": {"plan": "pro", "n": [1, 2]}}


def event(kind, **data):
    return json.dumps({"type": kind, "data": data})


def parsed(spark, texts):
    df = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", t) for i, t in enumerate(texts)], "event_id long, at string, value string")
    return messages.parse_change_events(df.withColumn("ts", F.to_timestamp_ntz("at")).drop("at"))


def test_payload_fields(spark):
    row = parsed(spark, [json.dumps({"type": "user.created", "data": PAYLOAD})]).first()
    assert (row.user_id, row.email, row.first_name, row.last_name) == ("user_1", "a@example.com", "Ada", None)
    assert json.loads(row.public_metadata) == PAYLOAD["public_metadata"]


def test_defaults_and_bad_messages(spark):
    got = parsed(spark, [event("user.created", id="u"), "{broken", "", "[]", '{"data": {"id": "x"}}', event("user.deleted", id="u", deleted=True)])
    assert rows(got, "event_id", "type", "email", "public_metadata") == [
        (0, "user.created", None, "{}"), (5, "user.deleted", None, "{}")]


def base(spark):
    return spark.createDataFrame([("kept", "kim", True), ("u", "uma", True), ("gone", "gil", True)], "user_id string, username string, is_active boolean"
                                 ).withColumns({c: F.lit(None).cast("string") for c in U.SYNC_COLUMNS})


STORY = [
    event("user.created", id="u", first_name="A", email_addresses=[{"email_address": "1@x.org", "id": "e"}]),
    event("user.updated", id="u", first_name="B"),
    event("user.created", id="new", first_name="N"),
    event("user.deleted", id="gone"),
    event("user.deleted", id="stranger"),
    event("user.deleted", id="back"),
    event("user.created", id="back", first_name="Z"),
    event("user.created", id="left", first_name="L"),
    event("user.deleted", id="left"),
    event("session.started", id="u"),
    event("user.updated", first_name="nobody"),
]
EXPECTED = [
    ("back", None, "Z", None, True), ("gone", "gil", None, None, False), ("kept", "kim", None, None, True),
    ("left", None, "L", None, False), ("new", None, "N", None, True), ("u", "uma", "B", None, True),
]
COLUMNS = ["user_id", "username", "first_name", "email", "is_active"]


def test_sync_story(spark):
    assert rows(U.sync(base(spark), parsed(spark, STORY)), *COLUMNS) == EXPECTED


def test_sync_in_parts_and_twice_is_the_same(spark):
    events = parsed(spark, STORY)
    halves = [U.fold_events(events.filter("event_id % 2 = 1")), U.fold_events(events.filter("event_id % 2 = 0")), U.fold_events(events)]
    parts = halves[0].unionByName(halves[1]).unionByName(halves[2])
    assert rows(U.apply_folds(base(spark), U.merge_folds(parts)), *COLUMNS) == EXPECTED
    once = U.sync(base(spark), events)
    assert rows(U.sync(once, events), *COLUMNS) == EXPECTED


def test_cascade(spark):
    children = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, user_id string")
    deleted = spark.createDataFrame([("a",), ("a",)], "user_id string")
    assert rows(U.cascade_delete(children, deleted, "user_id", "user_id"), "id") == [(2,)]


def test_shields(spark):
    users = spark.createDataFrame([("a", 0), ("b", 5)], "user_id string, inbox_shield_threshold int")
    updates = spark.createDataFrame([("a", "a", 200, 1, 1), ("b", "a", 999, 2, 2), ("a", "a", -1, 3, 3), ("b", "b", 7, 1, 1), ("b", "b", 0, 1, 2)],
                                    "requester_id string, user_id string, threshold int, ts int, seq int")
    assert rows(U.set_shields(users, updates), "user_id", "inbox_shield_threshold") == [("a", 200), ("b", 0)]


def test_schema_upgrade(spark):
    df = spark.createDataFrame([("a", None), ("b", False)], "user_id string, is_active boolean")
    got = U.add_columns(df, {"is_active": F.lit(True), "karma_score": F.lit(0)})
    assert rows(got) == [("a", True, 0), ("b", False, 0)]
