from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kindred.llm import neighbours, queries
from kindred.session import settle

SF = "/root/testdata/sf0.1"


def exact(rows, query_ids, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for q in query_ids:
        d = np.sqrt(((vectors - vectors[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def asked(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_of_the_query(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = exact(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = asked(queries.op9_nearest(spark, SF))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.97
    true = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(abs(true.get((q, i), s) - s) < 1e-12 for q, found in got.items() for i, s in found)


def test_recall_with_clusters_over_many_blocks(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(0, 0.2, 24)).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = asked(neighbours.nearest(table, table.where("vec_id % 50 = 0"), block=700, query_block=16))
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 10)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / (10 * len(want)) >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 3), (3, [0.0, 0.0], 4), (4, None, 5), (5, [float("nan"), 1.0], 6),
            (6, [float("inf"), 1.0], 7), (7, [None, 1.0], 8), (8, [1.0, 2.0, 3.0], 9), (None, [1.0, 0.1], 10), (9, [], 11),
            (10, [0.0, 2.0], 12), (1, [1.0, 0.0], 13), (1, [5.0, 0.0], 14)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumn("rank", F.lit(1))
    got = asked(neighbours.nearest(table, table))
    assert set(got) == {0, 1, 2, 10}
    assert [i for i, _ in got[0]] == [1, 2, 10] and [s for _, s in got[0]][:2] == [0.0, 0.0]
    assert [i for i, _ in got[10]] == [0, 1, 2]
    assert neighbours.nearest(table.where("vec_id < 0"), table).count() == 0
    many = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    assert [i for i, _ in asked(neighbours.nearest(many, many.where("vec_id = 100")))[100]] == list(range(10))


def test_queries_go_only_to_the_blocks_their_windows_reach(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 32))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.02, 32)).tolist()) for i in range(4000)]
    # A third of all rows are copies of one vector.
    rows += [(4000 + i, rows[0][1]) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = {}

    def keep(df, name):
        kept[name] = settle(df, name)
        return kept[name]

    monkeypatch.setattr(neighbours, "settle", keep)
    got = asked(neighbours.nearest(table, table.where("vec_id % 50 = 0"), block=150, query_block=16))
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 10)
    assert set(got) == set(want)
    assert sum(abs(got[q][-1][1] - want[q][-1][1]) < 1e-9 for q in want) / len(want) >= 0.95
    assert got[0] == [(i, 0.0) for i in range(4000, 4010)]
    blocks = kept["home"].where("low IS NOT NULL").count()
    assert blocks >= 40 and kept["opened"].count() < 0.5 * blocks * len(want)
    sizes = kept["cells"].groupBy("cell").count().agg(F.max("count")).first()[0]
    assert sizes > 2000


def test_a_bounded_search_keeps_what_lies_within(spark):
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(0, 1, (2000, 16)), np.arange(2000)
    free = list(neighbours.search_block(vectors, ids, vectors[:20], ids[:20], 10))
    limits = np.array([scores[4] for _, _, scores in free])
    for (_, all_ids, all_scores), (_, some, scores) in zip(
            free, neighbours.search_block(vectors, ids, vectors[:20], ids[:20], 10, limits), strict=True):
        assert some.tolist() == all_ids[:5].tolist() and scores.tolist() == all_scores[:5].tolist()
