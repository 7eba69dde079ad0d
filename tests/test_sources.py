"""Typed scans, sinks and message formats."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from kindred.plans.matching import message_counts
from kindred.schemas import TABLES
from kindred.session import shared_dir
from kindred.sources import messages, tables
from tests.conftest import rows


def test_declared_schema_is_read_and_pruned(spark):
    path = shared_dir(spark, "communities")
    df = spark.createDataFrame([("c1", "Chess", True), ("c2", "Go", False)], "community_id string, community_name string, is_active boolean")
    tables.conform(df, "communities").write.parquet(path)
    back = tables.read_table(spark, path, "communities")
    assert back.schema.names == TABLES["communities"].names
    picked = back.filter("is_active").select("community_id")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(is_active), EqualTo(is_active,true)]" in plan
    assert "ReadSchema: struct<community_id:string,is_active:boolean>" in plan
    assert rows(picked) == [("c1",)]


def test_ledger_sink_appends_ids_and_times(spark):
    path = shared_dir(spark, "ledger")
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    entries = spark.createDataFrame([("u", "EVENT_RSVP", 10, "e1"), ("v", "EVENT_RSVP", 10, None)],
                                    "user_id string, action_type string, point_delta int, reference_id string")
    tables.append_ledger(entries, path, now)
    tables.append_ledger(entries, path, now + F.expr("INTERVAL 1 DAY"))
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("id").distinct().count() == 4
    assert back.select("entry_date").distinct().count() == 2
    assert back.filter("id is null or created_at is null").count() == 0


def test_channels_round_trip(spark):
    df = spark.createDataFrame([("user_7",)], "user_id string")
    name = messages.channel(F.col("user_id"))
    assert rows(df.select(name, messages.channel_user(name))) == [("match_updates_user_7", "user_7")]


def test_publish_then_subscribe(spark):
    results = spark.createDataFrame([("a", "soulmate", None, [1, 2]), ("b", "fallback", "c9", [])],
                                    "user_id string, tier string, joined string, ids array<int>")
    keyed = messages.keyed_messages(results)
    assert json.loads(keyed.filter("key = 'match_updates_a'").first().value) == {
        "user_id": "a", "tier": "soulmate", "joined": None, "ids": [1, 2]}
    noise = spark.createDataFrame([("other_a", "{}"), ("match_updates_z", "{not json")], "key string, value string")
    path = shared_dir(spark, "keyed")
    messages.publish(keyed.unionByName(noise), "parquet", path=path)
    got = messages.parse_results(spark.read.parquet(path), "tier string, ids array<int>")
    assert rows(got, "user_id", "result.tier") == [("a", "soulmate"), ("b", "fallback")]


def test_inline_sample_rows_with_relative_times(spark):
    """Sample rows written as SQL VALUES with ages, placed relative to a given moment."""
    got = spark.sql("""
        SELECT message_id, TIMESTAMP_NTZ '2024-06-15 12:00:00' - make_dt_interval(0, hours) AS created_at
        FROM VALUES ('m1', 1), ('m2', 24) AS t(message_id, hours)""")
    assert [str(r.created_at) for r in got.orderBy("message_id").collect()] == ["2024-06-15 11:00:00", "2024-06-14 12:00:00"]


def test_trailing_window_reads_only_its_days(spark):
    path = shared_dir(spark, "activity")
    df = spark.range(2000).select(
        F.col("id").alias("message_id"), (F.col("id") % 7).alias("community_id"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 720).cast("int"))).alias("created_at"))
    tables.append_dated(df, path, "created_at")
    stored = spark.read.parquet(path)
    now = F.lit("2024-03-20 12:00:00").cast("timestamp_ntz")
    counted = message_counts(stored, now)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entry_date" in plan and ">= 2024-03-13" in plan
    assert "ReadSchema: struct<community_id:bigint,created_at:timestamp_ntz>" in plan
    assert rows(counted) == rows(message_counts(df, now))
