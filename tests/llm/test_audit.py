from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from kindred.llm import audit
from tests.llm.conftest import wide


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {n for n, f in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                           ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                           ("D", bool(re.search(r"[#$%&*|]", text)))) if f}


def plain(rows, labels):
    """Every order applied to the rows one filter after the other."""
    marks = []
    for doc_id, text, source in rows:
        text, marked = text or "", failed(text or "")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            marked.add("E")
        marks.append((source or "", marked, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None),
                      any(i == doc_id and x == 1 for i, _, x in labels if i is not None)))
    out = {}
    shapley = Counter()
    for part in {m[0] for m in marks}:
        for order in permutations("ABCDE"):
            left = [m for m in marks if m[0] == part]
            for step, name in enumerate(order, 1):
                gone = [m for m in left if name in m[1]]
                left = [m for m in left if name not in m[1]]
                all_fail = [m for m in marks if m[0] == part and name in m[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(all_fail) - len(gone), sum(m[1] == {name} for m in all_fail),
                    sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_equals_filters_applied_in_every_order(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice(["ab ", "CD ", "e%f ", f"w{i} "]) for i in range(rng.choice([3, 150, 250]))) for _ in range(60)]
    rows = [(rng.choice([None, *range(300)]), rng.choice([*pool, None, "", "hot text", "hot text", "hot text"]),
             rng.choice([None, "", "web", "web", "news"])) for _ in range(400)]
    labels = [(rng.choice([None, *range(300)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(200)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string")
    got = found(audit.interactions(docs.repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain(rows, labels)


def test_a_full_sketch_only_sends_more_rows(spark, monkeypatch):
    rows = [(i, f"text {i % 700} {'x ' * (i % 3)}", "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = sorted(map(tuple, audit.flags(docs).collect()))
    monkeypatch.setattr(audit, "counters", lambda rows: audit.SEGMENT)
    assert sorted(map(tuple, audit.flags(docs).collect())) == want


def test_unique_texts_are_cleared_and_repeats_never(spark):
    hashes = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    both = np.concatenate([hashes, hashes[:500]])
    frame = spark.createDataFrame([(int(h),) for h in both], "name long").repartition(6)
    size = audit.counters(len(both))
    plane = audit.merged_sketch(frame, size)
    assert audit.repeated(plane, hashes[:500]).all()
    assert audit.repeated(plane, hashes[500:]).mean() < 0.05
    one = audit.Sketch(size)
    one.add(both)
    assert (one.twice == plane).all()


def test_edges(spark, edge, none):
    labels = spark.createDataFrame([(3, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = found(audit.interactions(edge.withColumnRenamed("row", "source"), labels))
    assert len(got) == 600
    from tests.llm.conftest import EDGE_ROWS
    assert got == plain([(i, t, "row") for i, t in EDGE_ROWS], [(3, 1, 1), (7, 1, None)])
    assert audit.interactions(none.withColumnRenamed("row", "source"), labels).count() == 0
    assert wide(spark, []).count() == 0
