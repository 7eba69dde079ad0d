"""The skew-safe operators must equal the plain window, also when a key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.operators.skew import page_per_key, running_by_key, top_k_per_key
from tests.conftest import rows


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        user = 1 if rng.random() < 0.4 else rng.randint(2, 60)
        seconds = rng.randint(0, 30 * 86400)
        data.append((i, user, rng.randint(-20, 30), rng.choice([None, "a", "b", "c"]), seconds // 60 * 60))
    df = spark.createDataFrame(data, "id long, user_id long, delta int, tag string, sec long")
    return df.withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").cache()


def plain_running(df):
    w = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum("delta").over(w)).withColumn(
        "tag_now", F.last("tag", ignorenulls=True).over(w))


@pytest.mark.parametrize("hot_rows", [0, 50, 500, 10**9])
def test_running_equals_plain_window(ledger, hot_rows):
    got = running_by_key(ledger, ["user_id"], "ts", "id", sums={"total": F.col("delta")},
                         lasts={"tag_now": F.col("tag")}, hot_rows=hot_rows)
    assert rows(got, "id", "total", "tag_now") == rows(plain_running(ledger), "id", "total", "tag_now")


def test_running_keeps_every_row_of_a_hot_key(ledger):
    got = running_by_key(ledger, ["user_id"], "ts", "id", sums={"n": F.lit(1)}, hot_rows=10)
    assert got.count() == ledger.count()
    assert got.filter("user_id = 1").agg(F.max("n")).first()[0] == ledger.filter("user_id = 1").count()


@pytest.mark.parametrize("hot_rows", [0, 100, 10**9])
def test_descending_running_values(ledger, hot_rows):
    got = running_by_key(ledger, ["user_id"], "ts", "id", sums={"total": F.col("delta")},
                         lasts={"tag_now": F.col("tag")}, hot_rows=hot_rows, descending=True)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = ledger.withColumn("total", F.sum("delta").over(w)).withColumn("tag_now", F.last("tag", ignorenulls=True).over(w))
    assert rows(got, "id", "total", "tag_now") == rows(want, "id", "total", "tag_now")


def test_one_timestamp_is_cut_over_several_tasks(spark):
    """Half the rows have one key (null) and one timestamp; no task gets much more than its share."""
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running_by_key(df, ["k"], "ts", "id", sums={"n": F.lit(1)}, hot_rows=1000)
    hot = got.filter("k IS NULL")
    assert hot.count() == 10_000 and hot.agg(F.max("n"), F.countDistinct("n")).first()[:] == (10_000, 10_000)
    assert hot.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] <= 6_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_keys_cost_one_aggregate(spark, ledger):
    """Building without a hot key runs the count and nothing else."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    running_by_key(ledger, ["user_id"], "ts", "id", sums={"n": F.lit(1)}, hot_rows=10**9, population=ledger.select("user_id"))
    jobs = tracker.getJobIdsForGroup("build")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 4


@pytest.mark.parametrize("salts", [None, 1, 7])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_k_equals_plain_rank(ledger, k, salts):
    order = [F.desc("delta"), F.asc("id")]
    w = Window.partitionBy("user_id").orderBy(*order)
    want = ledger.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    got = top_k_per_key(ledger, ["user_id"], order, k, salt_on=["id"] if salts else None, salts=salts or 1)
    assert rows(got, "id", "rn") == rows(want, "id", "rn")


@pytest.mark.parametrize("limit,offset", [(1, 0), (10, 5), (20, 2000), (1000, 0), (1001, 0), (1500, 30)])
def test_page_equals_limit_offset(ledger, limit, offset):
    ledger = ledger.withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id")))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    want = ledger.withColumn("rn", F.row_number().over(w)).filter(F.col("rn").between(offset + 1, offset + limit))
    got = page_per_key(ledger, "user_id", "ts", "id", limit, offset)
    assert rows(got, "id", "rn") == rows(want, "id", "rn")


def test_rank_limit_runs_before_the_shuffle(ledger):
    got = top_k_per_key(ledger, ["user_id"], [F.desc("delta"), F.asc("id")], 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
