"""Positions, phrase rules, award steps, bucketed tables and the stored vector index."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.catalog.base import DIM, Views
from kindred.operators import phrases, vector_index
from kindred.operators.ranking import with_position
from kindred.operators.similarity import top_k_by_cosine
from kindred.plans import ledger, users
from kindred.session import shared_dir
from kindred.sources import tables
from tests.conftest import rows


PROBES = 0.8


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


def test_positions_of_all_rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, *range(20)])) for i in range(5000)]
    df = spark.createDataFrame(data, "id int, score int").repartition(13)
    ranked = with_position(df, [F.desc_nulls_last("score"), F.asc("id")])
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert rows(ranked, "position", "id") == sorted(((n, i) for n, (i, _) in enumerate(want, 1)), key=repr)
    assert "Window" not in plan(ranked) and "SinglePartition" not in plan(ranked)
    assert with_position(df.limit(0), [F.asc("id")]).count() == 0


def test_phrases_equal_a_plain_search(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    rules = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))), f"t{i % 17}") for i in range(300)]
    rules += [("Code   DAILY!", "programming"), ("", "nothing"), (" - ", "nothing"), (None, "nothing"), ("w1", None)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(120)]
    texts += [(900, "I code daily."), (901, "code; daily"), (902, "codedaily daily code"), (903, None), (904, "")]
    got = phrases.implied_tags(spark.createDataFrame(texts, "user_id int, bio string"),
                               spark.createDataFrame(rules, "phrase string, tag string"), "user_id", "bio")
    import re
    plain = {}
    for i, text in texts:
        said = " " + " ".join(w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w) + " "
        for phrase, tag in rules:
            words = [w for w in re.split("[^a-z0-9]+", (phrase or "").lower()) if w]
            if words and tag and f" {' '.join(words)} " in said:
                plain.setdefault(i, set()).add(tag)
    assert {r.user_id: set(r.tags) for r in got.collect()} == plain and plain[900] == plain[901] == {"programming"}


def test_ten_thousand_rules_do_not_grow_the_plan(spark):
    texts = spark.createDataFrame([(1, "we code daily", ["Own"])], "user_id int, bio string, interest_tags array<string>")
    few = spark.createDataFrame([("code daily", "programming")], "phrase string, tag string")
    many = few.unionByName(spark.range(10_000).select(
        F.concat(F.lit("rule "), "id").alias("phrase"), F.concat(F.lit("t"), "id").alias("tag")))
    small, large = phrases.enrich(texts, few), phrases.enrich(texts, many)
    assert rows(large, "enriched_tags") == rows(small, "enriched_tags") == [(["Own", "programming"],)]
    assert len(plan(large)) < len(plan(small)) + 2500
    assert phrases.enrich(texts, few.limit(0)).first().enriched_tags == ["Own"]


def test_award_steps_equal_one_run(spark, views):
    path = shared_dir(spark, "steps")
    days = F.dayofmonth("created_at")
    parts = [views.award_requests.filter(days.between(a, b)) for a, b in ((1, 9), (10, 19), (20, 31))]
    for step in (0, 1, 1, 2):  # a step that runs again changes nothing
        last = ledger.award_step(parts[step], views.users, views.shield, path, step)
    one = ledger.award(views.award_requests, views.users, views.ledger.limit(0), views.shield)
    columns = ["id", "user_id", "balance", "tier", "inbox_shield_threshold"]
    awards = spark.read.parquet(f"{path}/awards")
    assert rows(awards, *columns) == rows(one, *columns)
    assert rows(last, "id") == rows(awards.filter("step = 2"), "id")
    want = one.groupBy("user_id").agg(F.sum("point_delta").alias("balance"), F.count(F.lit(1)).alias("awards"))
    assert rows(ledger.last_totals(ledger.stored_totals(spark, path)), "user_id", "balance", "awards") == rows(want)
    folded = shared_dir(spark, "folded")
    ledger.fold_totals(spark, path, folded)
    assert rows(ledger.stored_totals(spark, folded), "user_id", "balance", "awards") == rows(want)


def test_a_step_reads_totals_and_no_old_awards(spark, views, monkeypatch):
    path = shared_dir(spark, "steps")
    ledger.award_step(views.award_requests.filter("id % 2 = 0"), views.users, views.shield, path, 0)
    seen = []
    real = ledger.award
    monkeypatch.setattr(ledger, "award", lambda *a, **o: seen.append(real(*a, **o)) or seen[-1])
    requests = views.award_requests.filter("id % 2 = 1 AND user_id < 5")
    ledger.award_step(requests, views.users, views.shield, path, 1)
    text = plan(seen[0])
    assert f"{path}/awards" not in text and "opening" in text


def test_bucketed_tables_stay_where_they_lie(spark, views):
    def stored(df, name):
        path = shared_dir(spark, name)
        return tables.save_bucketed(df, path.rsplit("/", 1)[-1].replace("-", "_"), path, "user_id", 8), path

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        people, _ = stored(views.users, "people")
        members, _ = stored(views.members, "members")
        points, path = stored(views.ledger, "points")
        joined = people.join(members, "user_id")
        assert "Exchange" not in plan(joined) and joined.count() == views.users.join(views.members, "user_id").count()
        sums = points.groupBy("user_id").agg(F.sum("point_delta").alias("s"))
        assert "Exchange" not in plan(sums) and rows(sums) == rows(views.ledger.groupBy("user_id").agg(F.sum("point_delta").alias("s")))
        # An upsert moves the day's events only.
        current, _ = stored(views.users.select("user_id", "username", "is_active").withColumns(
            {c: F.lit(None).cast("string") for c in users.SYNC_COLUMNS}), "current")
        merged = users.sync(current, views.change_events.filter("event_id < 100"))
        assert plan(merged).count("Exchange hashpartitioning") == 1
        # Another session names the stored files again.
        schema = ", ".join(f"`{c}` {t}" for c, t in views.ledger.dtypes)
        again = tables.open_bucketed(spark, "points_again", path, schema, "user_id", 8)
        assert again.count() == points.count() and "Exchange" not in plan(again.groupBy("user_id").count())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exploded(df):
    return rows(df.select("user_id", F.posexplode("matches").alias("at", "m")).select("user_id", "at", "m.community_id", "m.match_score"))


@pytest.fixture(scope="module")
def cells(spark):
    """Clustered vectors of three places, one with half of all rows, stored as an index."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, DIM))

    def some(n):
        return [(int(i), f"c{max(0, i % 6 - 3)}", "t", (centres[i % 12] + rng.normal(0, 0.6, DIM)).tolist()) for i in range(n)]

    schema = "{0} long, city string, timezone string, vector array<double>"
    groups = spark.createDataFrame(some(3000) + [(9000, None, "t", [1.0] * DIM), (9001, "c1", "t", [1.0]), (9002, "c1", "t", None)],
                                   schema.format("community_id"))
    people = spark.createDataFrame(some(300) + [(900, "nowhere", "t", [1.0] * DIM), (901, "c1", "t", None), (902, None, "t", [1.0] * DIM)],
                                   schema.format("user_id"))
    path = shared_dir(spark, "index")
    vector_index.build(groups.select("community_id", "city", "timezone"), groups.select("community_id", "vector"), DIM, path, ["community_id"])
    whole = top_k_by_cosine(people, groups.select("community_id", "city", "timezone"), groups.select("community_id", "vector"), DIM,
                            fields=["community_id"])
    return groups, people, path, whole


def test_cells_hold_every_usable_vector(spark, cells):
    groups, _, path, _ = cells
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.count() == lists.select("community_id").distinct().count() == 3000
    stored = spark.read.parquet(f"{path}/cells")
    assert stored.groupBy("city").count().count() == 3 and stored.agg(F.sum("rows")).first()[0] == 3000


def test_recall_of_the_cells_and_exact_search(spark, cells):
    _, people, path, whole = cells
    near = vector_index.search(spark, people, path, DIM, ["community_id"], probes=0.3)
    want = {(u, c) for u, _, c, _ in exploded(whole)}
    got = {(u, c) for u, _, c, _ in exploded(near)}
    assert len(got & want) / len(want) >= 0.95
    exact = vector_index.search(spark, people, path, DIM, ["community_id"], probes=0.1, exact=True)
    assert exploded(exact) == exploded(whole)
    assert exact.count() == people.count() and {r.user_id for r in exact.filter("size(matches) = 0").collect()} == {900, 901, 902}


def test_recall_on_all_given_users(spark):
    """Some eighty vectors of no clear clusters to a location: most cells have to be read."""
    views = Views(spark, "/root/testdata/sf0.1")
    path = shared_dir(spark, "given")
    groups = views.communities.select("community_id", "city", "timezone")
    vector_index.build(groups, views.index, DIM, path, ["community_id"])
    whole = top_k_by_cosine(views.user_vectors, groups, views.index, DIM, fields=["community_id"])
    near = vector_index.search(spark, views.user_vectors, path, DIM, ["community_id"], probes=PROBES)
    want, got = (f.select("user_id", F.explode("matches.community_id").alias("c")) for f in (whole, near))
    assert want.join(got, ["user_id", "c"], "left_semi").count() >= 0.95 * want.count()


def test_a_search_moves_a_row_per_user_and_chunk(spark, cells, monkeypatch):
    """Not one per user and cell: users in blocks, vectors in chunks, a cell that is larger than a chunk in parts."""
    groups, people, _, whole = cells
    for name, value in {"LEAST_ROWS": 1, "BLOCK_VALUES": 40 * DIM, "CHUNK_VALUES": 70 * DIM, "SCORES": 1 << 10}.items():
        monkeypatch.setattr(vector_index, name, value)
    path = shared_dir(spark, "chunks")
    vector_index.build(groups.select("community_id", "city", "timezone"), groups.select("community_id", "vector"), DIM, path,
                       ["community_id"], cells=5)
    assert spark.read.parquet(f"{path}/cells").agg(F.max("rows")).first()[0] > 70
    seen = []
    real = vector_index.settle
    monkeypatch.setattr(vector_index, "settle", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    exact = vector_index.search(spark, people, path, DIM, ["community_id"], probes=0.3, exact=True)
    # The last digit of a score depends on how many columns are multiplied at once.
    assert [(*r[:3], round(r[3], 9)) for r in exploded(exact)] == [(*r[:3], round(r[3], 9)) for r in exploded(whole)]
    settled = dict(seen)
    assert settled["order"].count() == 300 and settled["chunks"].select("_chunk").distinct().count() > 5
    assert settled["order"].select("_city", "_block").distinct().count() > 5


def test_a_small_search_reads_only_its_cells(spark, cells):
    _, people, path, _ = cells
    cell = spark.read.parquet(f"{path}/cells").orderBy("cell").select("cell").limit(2)
    lists = vector_index._lists(spark, path, cell, vector_index.SLOTS)
    assert "PartitionFilters: [isnotnull(slot" in plan(lists) or "PartitionFilters: [slot" in plan(lists)
    assert "PushedFilters: [In(cell" in plan(lists) or "Or(EqualTo(cell" in plan(lists) or "cell, [" in plan(lists)
    everything = spark.read.parquet(f"{path}/lists")
    assert rows(lists, "community_id") == rows(everything.join(cell, "cell", "left_semi"), "community_id")


def test_a_group_of_texts_asks_once_for_a_stretch():
    """500 equal texts and one more: their stretches of one and two words, each once, and none that the filter rules out."""
    bits = np.full(1 << (phrases.FILTER - 6), np.uint64(2**64 - 1))
    batch = pa.RecordBatch.from_pydict({"_group": [7] * 501, "_words": [["a", "b", "a", "b"]] * 500 + [["c"]]})
    got = [(r["_group"], r["phrase"]) for part in phrases._asked([1, 2], bits)(iter([batch])) for r in part.to_pylist()]
    assert sorted(got) == [(7, "a"), (7, "a b"), (7, "b"), (7, "b a"), (7, "c")]
    assert not list(phrases._asked([1, 2], bits * np.uint64(0))(iter([batch])))
