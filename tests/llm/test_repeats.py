from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kindred.llm import queries, repeats
from tests.llm.conftest import EDGE_ROWS, SF


def plain(rows, length):
    """Every string of every text counted."""
    seen = Counter(b[i:i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in rows:
        depth = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                depth[i] += 1
                depth[i + length] -= 1
        gone = np.cumsum(depth[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted((tuple(r) for r in repeats.digests(df).collect()), key=repr)


def test_query_equals_brute_force(spark, docs):
    want = plain([(d, (t or "").encode()) for d, t in docs], 200)
    got = sorted((tuple(r) for r in queries.op4_repeats(spark, SF).collect()), key=repr)
    assert got == want and any(r[2] for r in want)


@pytest.mark.parametrize("length, spread, group", [(200, 100, 20_000), (40, 20, 1), (40, 33, 3)])
def test_planted_overlaps(spark, length, spread, group):
    rng = random.Random(length + spread)
    passages = ["".join(rng.choices("abcdeé ", k=rng.randrange(length - 5, 3 * length))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [p[rng.randrange(8):len(p) - rng.randrange(8)] for p in rng.sample(passages, rng.randrange(4))]
        rows.append((i, "".join(rng.choices("xyzw ", k=rng.randrange(300))) + "".join(
            p + "".join(rng.choices("xyzw", k=rng.randrange(30))) for p in parts)))
    rows += [(100, "a" * 900), (101, "ab" * 400), (102, "b" * (length - 1)), (103, passages[0] * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain([(d, t.encode()) for d, t in rows], length)
    for block in (2_000, 1 << 20):
        assert digest(repeats.removed(table, length, spread, block, group)) == want


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdef", k=5000))
    rows = [(1, "x" + shared + "y"), (2, shared[2000:2400]), (3, "".join(rng.choices("ghij", k=4000))), (4, shared[4900:] + "q" * 150)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(repeats.removed(table)) == plain([(d, t.encode()) for d, t in rows], 200)


def test_edges(spark, edge, none):
    assert digest(repeats.removed(none)) == []
    got = digest(repeats.removed(edge))
    assert got == digest_of_long_rows(EDGE_ROWS)


def digest_of_long_rows(rows):
    """The two very long texts of the fixture repeat themselves from end to end; the others are short."""
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = len(b) if len(b) > 10_000 else 0
        out.append((doc_id, len(b), gone, int(gone > 0), hashlib.sha256(b"" if gone else b).hexdigest()))
    return sorted(out, key=repr)
