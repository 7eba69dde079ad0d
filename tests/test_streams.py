"""Streams over several micro-batches give what the batch jobs give on the same rows."""

from __future__ import annotations

import datetime
import json
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kindred.catalog.base import DIM, Views, as_of
from kindred.plans import delivery, matching, preferences, users
from kindred.schemas import PREFERENCE_FIELDS
from kindred.session import shared_dir
from kindred.sources import messages
from kindred.streaming import jobs, keyed, sinks
from tests.conftest import rows


class ManyBatches(Views):
    """The events table cut into several files, read as a stream one file per micro-batch."""

    def __init__(self, spark, sf_dir, path):
        super().__init__(spark, sf_dir)
        self.path = path

    def table(self, name):
        if name != "events":
            return super().table(name)
        return (self.spark.readStream.schema(super().table("events").schema)
                .option("maxFilesPerTrigger", 1).parquet(self.path))


@pytest.fixture(scope="module")
def batch(spark, sf_dir):
    return Views(spark, sf_dir)


@pytest.fixture(scope="module")
def stream(spark, sf_dir, batch):
    path = shared_dir(spark, "events")
    for i in range(4):  # written in time order, one file each
        part = batch.events.filter(F.floor(F.dayofmonth("ts") / 8) == i).coalesce(1)
        part.write.mode("append").parquet(path)
    return lambda: ManyBatches(spark, sf_dir, path)


def run(spark, name, start):
    """Output folder and checkpoint of a job that has run over all there is."""
    base = shared_dir(spark, name)
    start(f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out", f"{base}/checkpoint"


def fed(spark, name, schema, start):
    """A function that adds rows to a source folder and runs the job ``start(stream, out, checkpoint)`` on; and its folders."""
    folder, base = shared_dir(spark, name), shared_dir(spark, f"{name}-out")

    def deliver(*data):
        if data:
            spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(folder)
        else:
            spark.createDataFrame([], schema).write.mode("append").parquet(folder)
        query = start(spark.readStream.schema(schema).parquet(folder), f"{base}/out", f"{base}/checkpoint")
        query.awaitTermination()
        return query

    return deliver, f"{base}/out", f"{base}/checkpoint"


def test_scores(spark, stream, batch):
    out, _ = run(spark, "scores", lambda p, c: jobs.score_stream(stream().ledger, p, c))
    assert sinks.read(spark, out, jobs.SCORES).select("batch").distinct().count() >= 2
    want = batch.ledger.groupBy("user_id").agg(F.sum("point_delta").alias("karma_score"))
    assert rows(jobs.current_scores(spark, out), "user_id", "karma_score") == rows(want)


def test_user_sync(spark, stream, batch):
    base = batch.users.select("user_id", "username", "is_active").withColumns(
        {c: F.lit(None).cast("string") for c in users.SYNC_COLUMNS})

    def parse(v):
        return messages.parse_change_events(v.change_messages).withColumn("user_id", F.col("user_id").cast("long"))

    out, checkpoint = run(spark, "sync", lambda p, c: jobs.user_sync_stream(parse(stream()), p, c))
    columns = ["user_id", "username", "email", "first_name", "last_name", "public_metadata", "is_active"]
    assert rows(jobs.synced_users(base, checkpoint), *columns) == rows(users.sync(base, parse(batch)), *columns)
    state = sinks.state(spark, checkpoint)
    assert state.count() == state.select("user_id").distinct().count() == users.handled(parse(batch)).select("user_id").distinct().count()
    # The newest row a user's stream sent is the user's row in the state, on a run from the start as well.
    newest = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*")
    assert rows(newest, *state.columns) == rows(state)
    again, _ = run(spark, "sync", lambda p, c: jobs.user_sync_stream(parse(stream()), p, c))
    assert rows(spark.read.parquet(again)) == rows(spark.read.parquet(out))


EVENT = "user_id long, type string, ts timestamp, event_id long, email string"


def test_one_changed_user_is_one_row(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    deliver, out, checkpoint = fed(spark, "changes", EVENT, lambda s, p, c: jobs.user_sync_stream(s, p, c, ["email"]))

    def sent():
        return rows(spark.read.parquet(out), "user_id", "email", "deleted", "version")

    deliver(*[(u, "user.created", day(2), u, f"{u}@a") for u in range(50)], (None, "user.created", day(2), 99, "x"))
    first = sent()
    assert len(first) == 50
    deliver((7, "user.updated", day(3), 100, "7@b"), (7, "user.updated", day(3), 101, "7@c"), (8, "session.started", day(3), 102, None))
    assert [r for r in sent() if r not in first] == [(7, "7@c", False, 2)]
    # An older event, a repeated one and an empty batch change nothing; an older upsert does not undo a delete.
    deliver((7, "user.updated", day(1), 90, "7@old"), (9, "user.created", day(2), 9, "9@a"))
    deliver()
    assert len(sent()) == 51
    deliver((7, "user.deleted", day(5), 110, None), (60, "user.deleted", day(5), 111, None))
    deliver((7, "user.updated", day(4), 105, "7@d"), (60, "user.created", day(4), 106, "60@a"))
    base = spark.createDataFrame([(7, "seven", None, True), (70, "seventy", None, True)], "user_id long, username string, email string, is_active boolean")
    now = {r[0]: r[1:] for r in rows(jobs.synced_users(base, checkpoint, ["email"]), "user_id", "username", "email", "is_active")}
    assert now[7] == ("seven", "7@d", False) and now[60] == (None, "60@a", False) and now[70] == ("seventy", None, True)
    assert len(now) == 52


def test_streams_without_a_batch_are_empty_tables(spark):
    nowhere = shared_dir(spark, "nothing")
    base = spark.createDataFrame([(1, "a", True)], "user_id long, username string, is_active boolean").withColumns(
        {c: F.lit(None).cast("string") for c in users.SYNC_COLUMNS})
    assert rows(jobs.synced_users(base, nowhere), "user_id", "is_active") == [(1, True)]
    assert jobs.current_preferences(spark, nowhere).count() == jobs.present(spark, nowhere).count() == 0
    assert jobs.current_scores(spark, nowhere).count() == jobs.daily_counts(spark, nowhere).count() == 0
    assert jobs.late_rows(spark, nowhere).count() == jobs.live_entries(spark, nowhere, as_of(), "value double").count() == 0
    deliver, out, _ = fed(spark, "no-points", "user_id long, point_delta int", lambda s, p, c: jobs.score_stream(s, p, c))
    deliver()
    assert jobs.current_scores(spark, out).count() == 0


def test_preferences(spark, stream, batch):
    columns = ["user_id", *PREFERENCE_FIELDS, "onboarding_complete", "updated_at"]
    stored = preferences.fold(batch.pref_patches.filter("user_id % 3 = 0")).select("user_id", *PREFERENCE_FIELDS).withColumns(
        {"created_at": as_of(), "updated_at": F.lit(None).cast("timestamp_ntz")})
    out, checkpoint = run(spark, "prefs", lambda p, c: jobs.preference_stream(
        stream().patch_requests, p, c, batch.users, stored, as_of()))
    want = preferences.update(batch.patch_requests, batch.users, stored, as_of())
    assert rows(jobs.current_preferences(spark, checkpoint), *columns) == rows(want, *columns)
    # What was sent last is the whole row, flag included, and each batch sends a user once.
    sent = spark.read.parquet(out)
    assert sent.count() == sent.select("user_id", "version").distinct().count()
    newest = sent.groupBy("user_id").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*")
    touched = want.filter(F.col("updated_at").isNotNull())
    assert rows(newest, *columns[:-1]) == rows(touched, *columns[:-1])


def test_presence(spark, stream, batch):
    week = 7 * 86_400_000
    out, checkpoint = run(spark, "presence", lambda p, c: jobs.presence_stream(stream().connections, p, c, "60 days", 60 * week))
    live = delivery.live_connections(batch.connections)
    assert rows(jobs.present(spark, checkpoint)) == rows(live)
    assert spark.read.parquet(out).filter("reason = 'silent'").count() == 0


def test_closed_and_silent_connections_leave_the_state(spark):
    hour = 3_600_000
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    deliver, out, checkpoint = fed(
        spark, "live", "user_id long, sid string, connected boolean, ts timestamp, event_id long",
        lambda s, p, c: jobs.presence_stream(s, p, c, "1 hour", 10 * hour))

    def known():
        return sorted(r.sid for r in sinks.state(spark, checkpoint, "connections").collect())

    deliver((1, "a", True, at(0), 1), (1, "b", True, at(0), 2), (2, "c", True, at(0), 3), (None, "x", True, at(0), 4))
    assert known() == ["a", "b", "c"]
    deliver((1, "b", False, at(1), 5), (2, "c", True, at(6), 6))
    assert rows(jobs.present(spark, checkpoint)) == [(1, "a"), (2, "c")]
    # The watermark passes the end of the closed one; a sign of life from before does not open it again.
    deliver((3, "d", True, at(9), 7), (1, "b", True, at(0), 2))
    assert known() == ["a", "c", "d"]
    # 10 hours after its last sign: a goes, c still lives. A user without connections has no row.
    deliver((3, "d", True, at(12), 8))
    assert rows(jobs.present(spark, checkpoint)) == [(2, "c"), (3, "d")]
    deliver((3, "e", True, at(40), 9))
    assert known() == ["e"]
    ended = spark.read.parquet(out).filter("reason = 'silent'")
    assert rows(ended, "user_id", "sid", "connected") == [(1, "a", False), (2, "c", False), (3, "d", False)]


def test_a_share_of_connections_costs_a_few_calls_of_the_state():
    calls = []

    class Handle:
        held = ()

        def getListState(self, name, schema):  # noqa: N802  Spark's name
            return self

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (iter(self.held) if name == "get" else None)

        def put(self, held):
            calls.append("put")
            self.held = held

    minute = 60_000
    processor = keyed._Connections(10 * minute, minute)
    processor.init(handle := Handle())
    events = [Row(sid=f"s{i}", connected=i % 2 == 0, at=i * minute * 1000, event_id=i) for i in range(1000)]
    assert len(list(processor.handleInputRows((1, 0), iter(events), None))) == 1000
    assert calls == ["get", "put", "registerTimer"] and len(handle.held) == 1000
    # Events that change the first end move the timer; old ones change nothing.
    calls.clear()
    assert not list(processor.handleInputRows((1, 0), iter([Row(sid="s9", connected=True, at=0, event_id=0)]), None))
    assert calls == ["get"]


def test_results_reach_connections_open_when_they_are_sent(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    folders = {n: shared_dir(spark, n) for n in ("results", "signs", "delivered", "checkpoint")}
    result, sign = "event_id long, user_id string, ts timestamp, tier string", "user_id string, sid string, connected boolean, ts timestamp, event_id long"

    def deliver(results, signs):
        for name, schema, data in (("results", result, results), ("signs", sign, signs)):
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folders[name])
        query = jobs.delivery_stream(spark.readStream.schema(result).parquet(folders["results"]),
                                     spark.readStream.schema(sign).parquet(folders["signs"]),
                                     folders["delivered"], folders["checkpoint"], reach="10 hours", delay="2 hours")
        query.awaitTermination()
        return query

    deliver([(1, "u", at(0), "early"), (2, "u", at(3), "open"), (3, "u", at(6), "closed"), (4, "v", at(20), "silent"), (5, "w", at(1), "nobody")],
            [("u", "s1", True, at(1), 1), ("u", "s2", True, at(2), 2), ("u", "s1", False, at(5), 3), ("v", "s3", True, at(5), 4)])
    query = deliver([(6, "u", at(4), "late"), (90, "end of results", at(500), "")],
                    [("u", "s2", True, at(4), 5), ("end of signs", "", True, at(500), 90)])
    got = sinks.read(spark, folders["delivered"], "event_id long, user_id string, tier string, sid string")
    assert rows(got, "event_id", "user_id", "tier", "sid") == [
        (2, "u", "open", "s1"), (2, "u", "open", "s2"), (3, "u", "closed", "s2"), (6, "u", "late", "s1"), (6, "u", "late", "s2")]
    assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 4


def test_connect_without_user_is_refused(spark):
    df = spark.createDataFrame([(None, "s1", True, 1, 1), ("u", "s2", True, 1, 2), ("u", "s3", True, 1, 3), ("u", "s3", False, 2, 4)],
                               "user_id string, sid string, connected boolean, ts int, event_id int")
    assert rows(delivery.live_connections(df)) == [("u", "s2")]


def test_daily_activity(spark, stream, batch):
    out, _ = run(spark, "daily", lambda p, c: jobs.daily_activity_stream(stream().activity, p, c))
    got = jobs.trailing_counts(jobs.daily_counts(spark, out))
    last = got.filter("day = date '2024-01-30'").select("community_id", "message_count")
    want = (batch.activity.filter("created_at >= timestamp_ntz '2024-01-24 00:00:00' and created_at < timestamp_ntz '2024-01-31 00:00:00'")
            .groupBy("community_id").agg(F.count(F.lit(1)).alias("message_count")))
    assert rows(last) == rows(want)


def test_cache_stream_equals_batch(spark, stream, batch):
    events = batch.cache_events
    path = shared_dir(spark, "cache-events")
    events.repartition(3).write.parquet(path)
    source = spark.readStream.schema(events.schema).parquet(path)
    _, checkpoint = run(spark, "cache", lambda p, c: jobs.cache_stream(source, p, c, ["value"]))
    for moment in (as_of(), as_of() - F.expr("INTERVAL 2 DAYS")):
        want = delivery.fresh_entries(events, moment, ["seq", "value"])
        assert want.count() > 0
        assert rows(jobs.live_entries(spark, checkpoint, moment, "value double"), "kind", "key", "seq", "value") == rows(
            want, "kind", "key", "seq", "value")


def test_entries_leave_the_store_when_their_time_has_passed(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    moment = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    # The clock moves by waiting: lifetimes of moments and of an hour.
    lives = {"query": 500, "user": 3_600_000}
    deliver, _, checkpoint = fed(spark, "entries", "kind string, key string, op string, ts timestamp, seq int, value double",
                                 lambda s, p, c: jobs.cache_stream(s, p, c, ["value"], lives))

    def held(kind):
        return rows(sinks.state(spark, checkpoint, kind), "key", "live", "seq", "value")

    deliver(*[("query", f"q{i}", "set", day(3), i, 1.0) for i in range(20)], ("user", "a", "set", day(3), 1, 1.0),
            ("user", "b", "set", day(3), 2, 2.0), ("mystery", "m", "set", day(3), 3, 3.0))
    assert held("user") == [("a", True, 1, 1.0), ("b", True, 2, 2.0)]
    time.sleep(1)
    deliver(("user", "a", "set", day(2), 9, 9.0), ("user", "b", "invalidate", day(3), 10, None), ("query", "new", "set", day(3), 11, 5.0),
            *[("query", f"q{i}", "set", day(1), 0, 0.0) for i in range(3)])
    # Older writes lose, a removal lets go of the payload, what has expired is gone.
    assert held("user") == [("a", True, 1, 1.0), ("b", False, 10, None)]
    assert {r[0] for r in held("query")} <= {"new", "q0", "q1", "q2"}
    assert rows(jobs.live_entries(spark, checkpoint, moment, "value double", ["user"]), "kind", "key") == [("user", "a")]


def test_lifetimes_and_invalidation(spark):
    events = spark.createDataFrame([
        ("user", "a", "set", "2024-01-01 00:00:00", 1, 1.0), ("user", "a", "set", "2024-01-02 00:00:00", 2, 2.0),
        ("user", "b", "set", "2024-01-02 00:00:00", 3, 1.0), ("user", "b", "invalidate", "2024-01-03 00:00:00", 4, None),
        ("user", "c", "invalidate", "2024-01-01 00:00:00", 5, None), ("user", "c", "set", "2024-01-02 00:00:00", 6, 3.0),
        ("group", "g", "set", "2024-01-08 23:00:00", 7, 4.0), ("group", "h", "set", "2024-01-08 00:00:00", 8, 5.0),
        ("query", "q", "set", "2024-01-08 23:50:00", 9, 6.0), ("query", "r", "set", "2024-01-08 23:45:00", 10, 7.0),
    ], "kind string, key string, op string, at string, seq int, value double")
    events = events.withColumn("ts", F.to_timestamp_ntz("at"))
    moment = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    # user: 7 days (a written exactly 7 days ago is gone), group: 24 hours, query: 15 minutes
    assert rows(delivery.fresh_entries(events, moment, ["value"]), "kind", "key", "value") == [
        ("group", "g", 4.0), ("query", "q", 6.0)]
    earlier = F.lit("2024-01-08 23:59:59").cast("timestamp_ntz")
    assert rows(delivery.fresh_entries(events, earlier, ["value"]), "kind", "key", "value") == [
        ("group", "g", 4.0), ("group", "h", 5.0), ("query", "q", 6.0), ("query", "r", 7.0), ("user", "a", 2.0), ("user", "c", 3.0)]


def test_match_stream(spark, batch, sf_dir):
    path = shared_dir(spark, "requests")
    batch.users.select("user_id").repartition(3).write.parquet(path)
    requests = spark.readStream.schema("user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    vectors = batch.user_vectors
    out, _ = run(spark, "matches", lambda p, c: jobs.match_stream(
        requests.join(vectors, "user_id"), p, c, matching.location_candidates(batch.communities, batch.activity, as_of()),
        matching.popular_communities(batch.communities, batch.activity, as_of()), batch.index, batch.members, dim=DIM))
    want = matching.match_results(vectors, batch.communities, batch.index, batch.activity, batch.members, as_of(), dim=DIM)
    columns = ["user_id", "tier", "auto_joined_community", "ai_intro_generated"]
    parts = spark.read.parquet(out)
    assert parts.select("batch").distinct().count() == 3
    assert rows(parts, *columns) == rows(want, *columns)


def test_replay_from_the_start_overwrites_its_own_parts(spark, stream, batch):
    """A lost checkpoint replays every batch under the same ids and must not double anything."""
    path, daily = shared_dir(spark, "replay"), shared_dir(spark, "replay-daily")
    for attempt in range(2):
        checkpoint = shared_dir(spark, f"replay-checkpoint-{attempt}")
        jobs.score_stream(stream().ledger, path, f"{checkpoint}/a").awaitTermination()
        jobs.daily_activity_stream(stream().activity, daily, f"{checkpoint}/b").awaitTermination()
    want = batch.ledger.groupBy("user_id").agg(F.sum("point_delta").alias("karma_score"))
    assert rows(jobs.current_scores(spark, path), "user_id", "karma_score") == rows(want)
    assert jobs.daily_counts(spark, daily).agg(F.sum("n")).first()[0] == batch.activity.count()


def test_restart_continues_from_the_checkpoint(spark):
    deliver, out, _ = fed(spark, "grow", "user_id long, point_delta int", lambda s, p, c: jobs.score_stream(s, p, c))
    for points in (5, 7):
        deliver((1, points))
    assert rows(jobs.current_scores(spark, out), "user_id", "karma_score") == [(1, 12)]


def test_late_rows_are_kept_aside_and_merged(spark):
    at = lambda d, h=10: datetime.datetime(2024, 1, d, h)
    deliver, out, _ = fed(spark, "late", "message_id long, community_id long, created_at timestamp_ntz",
                          lambda s, p, c: jobs.daily_activity_stream(s, p, c, delay_days=2))
    deliver((1, 1, at(20)))
    assert jobs.late_rows(spark, out).count() == 0
    deliver((2, 1, at(15)), (3, 1, at(19)), (4, 2, at(1)), (5, 1, at(18, 0)), (6, 1, at(17, 23)))
    assert rows(jobs.late_rows(spark, out), "message_id") == [(2,), (4,), (6,)]

    def trailing(corrected):
        return {(c, d.day): n for c, d, n in rows(jobs.trailing_counts(jobs.daily_counts(spark, out, corrected)))}

    closed, corrected = trailing(False), trailing(True)
    assert closed[1, 20] == 3 and corrected[1, 20] == 5
    assert (2, 1) not in closed and corrected[2, 1] == corrected[2, 7] == 1 and (2, 8) not in corrected


def test_published_results_come_back_once_over_restarts(spark):
    result = "user_id string, tier string, ids array<int>"
    folder, wire, got = (shared_dir(spark, n) for n in ("to-send", "wire", "received"))
    checkpoint = shared_dir(spark, "mail")
    for part in ([("a", "soulmate", [1, 2]), ("b", "fallback", [])], [("a", "explorer", [3])], []):
        spark.createDataFrame(part, result).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):
            jobs.publish_stream(spark.readStream.schema(result).parquet(folder), wire, f"{checkpoint}/out").awaitTermination()
            received = jobs.subscribe_stream(spark, wire, "tier string, ids array<int>")
            sinks.append(received.select("user_id", "result.tier", "result.ids"), got, f"{checkpoint}/in").awaitTermination()
    assert rows(spark.read.parquet(got)) == [("a", "explorer", [3]), ("a", "soulmate", [1, 2]), ("b", "fallback", [])]


def test_profile_lines_as_stream(spark):
    folder = shared_dir(spark, "lines")
    good = {"user_id": "u", "bio": "hello there bio", "interest_tags": ["a"], "city": "c", "timezone": "t"}
    spark.createDataFrame([(json.dumps(good),), ("{cut",), (json.dumps({**good, "city": None}),)], "value string").coalesce(1).write.text(folder)
    lines = messages.read_lines(spark, folder, stream=True)
    typed, bad = messages.parse_profiles(lines)
    assert typed.isStreaming and bad.isStreaming
    out, _ = run(spark, "typed", lambda p, c: sinks.append(typed, p, c))
    assert rows(spark.read.parquet(out), "user_id", "bio", "city") == [("u", "hello there bio", "c")]
    out, _ = run(spark, "bad", lambda p, c: sinks.append(bad, p, c))
    assert spark.read.parquet(out).count() == 2


def test_results_are_kept_by_user_and_stretch_of_time(spark):
    """So a result meets a user's signs of two stretches of time, not all that the state holds."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    folders = {n: shared_dir(spark, n) for n in ("results", "signs", "delivered", "checkpoint")}
    result, sign = "event_id long, user_id string, ts timestamp, tier string", "user_id string, sid string, connected boolean, ts timestamp, event_id long"
    spark.createDataFrame([(9, "u", at(30), "x")], result).write.parquet(folders["results"])
    spark.createDataFrame([("u", f"s{i}", True, at(i), i) for i in range(35)], sign).write.parquet(folders["signs"])
    jobs.delivery_stream(spark.readStream.schema(result).parquet(folders["results"]),
                         spark.readStream.schema(sign).parquet(folders["signs"]),
                         folders["delivered"], folders["checkpoint"], reach="10 hours", delay="48 hours").awaitTermination()
    state = spark.read.format("statestore").option("operatorId", 1).option("joinSide", "right").load(folders["checkpoint"])
    by_key = state.groupBy("key").count().collect()
    assert sorted(r["count"] for r in by_key) == [7, 8, 10, 10]
    # All of them are there in time for the result, from both stretches.
    spark.createDataFrame([(None, "end", at(999), "x")], result).write.mode("append").parquet(folders["results"])
    spark.createDataFrame([("end", "e", True, at(999), 99)], sign).write.mode("append").parquet(folders["signs"])
    jobs.delivery_stream(spark.readStream.schema(result).parquet(folders["results"]),
                         spark.readStream.schema(sign).parquet(folders["signs"]),
                         folders["delivered"], folders["checkpoint"], reach="10 hours", delay="48 hours").awaitTermination()
    got = spark.read.schema("event_id long, sid string").parquet(folders["delivered"]).filter("event_id = 9")
    assert {r.sid for r in got.collect()} == {f"s{i}" for i in range(20, 31)}
