from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import common, queries, simhash
from kindred.llm.components import components
from tests.llm.conftest import EDGE_ROWS, SF, wide


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def near(bits, distance=3):
    return [(a, b) for i, a in enumerate(bits) for b in bits[i + 1:] if (a ^ b).bit_count() <= distance]


def test_query_equals_brute_force(spark, docs):
    marks = {d: plain_fingerprint(t or "") for d, t in docs}
    ids = sorted(marks)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (marks[a] ^ marks[b]).bit_count() <= 3]
    want = groups(ids, linked)
    got = queries.op5_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{marks[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_exactly_what_is_near(spark, block):
    rng = random.Random(3)
    bits = {0, (1 << 64) - 1}
    for _ in range(40):
        seed = rng.getrandbits(64)
        bits |= {seed}
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 5)):
                seed ^= 1 << rng.randrange(64)
            bits.add(seed)
    bits = sorted(bits)
    points = spark.createDataFrame([(b - (1 << 64) if b >> 63 else b,) for b in bits], "bits long")
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(points, block=block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    assert groups(bits, pairs) == groups(bits, near(bits))


def test_one_huge_group_emits_no_pairs(spark):
    # 1,200 fingerprints, each within 3 bits of most others.
    bits = sorted({1 << a | 1 << b | 1 << c for a in range(20) for b in range(a) for c in range(b)})
    points = spark.createDataFrame([(b,) for b in bits], "bits long")
    pairs = [(r.a, r.b) for r in simhash.links(points, block=256).collect()]
    assert len(pairs) < 60 * len(bits) and groups(bits, pairs) == groups(bits, near(bits))


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert components(links.where("a < 0")).count() == 0


def test_edges(spark, edge, none):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE_ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by_id[i].fingerprint for i in (1, 2, 4)} == {"0" * 16} and {by_id[i].component_id for i in (1, 2, 4)} == {1}
    assert by_id[7].component_id == 3
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_keep_one(spark, edge):
    out = simhash.keep_one(edge)
    assert out.columns == edge.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert (1, None) in kept and (3, "the same row") in kept and kept.count((3, "the same row")) == 1
    assert not [d for d, _ in kept if d in (2, 4, 7)] and (None, "a text without an id") in kept
    # A group of rows without ids keeps one of them; an id that repeats with other texts is judged by row.
    rows = wide(spark, [(None, "p q r s"), (None, "P q r s"), (5, "one two three four"), (5, "p q r s"), (6, "p q r s")])
    left = sorted(((r.doc_id, r.text) for r in simhash.keep_one(rows).collect()), key=repr)
    assert left == [(5, "one two three four"), (5, "p q r s")]
    assert simhash.keep_one(rows.where(F.col("doc_id").isNull())).count() == 1
    # Hashes that meet do not make rows of two ids one.
    more = rows.withColumn("row", F.lit(1)).withColumn("row_id", F.lit("x"))
    assert simhash.keep_one(more).columns == more.columns and simhash.keep_one(more).count() == 2
    keyed, names = common.with_row_key(more)
    assert len(set(names) | set(more.columns)) == len(more.columns) + 2
    forged = spark.createDataFrame([(5, 7), (6, 7), (None, 7)], "doc_id long, row long")
    assert common.keys_of(forged, names).distinct().count() == 3
