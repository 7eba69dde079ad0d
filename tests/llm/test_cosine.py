from __future__ import annotations

import numpy as np
import pytest

from kindred.llm import cosine


def plain(rows, threshold=cosine.THRESHOLD):
    """Every pair, and components by walking the links."""
    def fits(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = [set() for _ in rows]
    for i, (_, label, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][2]
            if label is None or label != rows[j][1] or not fits(v) or not fits(w) or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            a, b = a / np.abs(a).max(), b / np.abs(b).max()
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def clustered(rng, n, dim, labels, spread):
    centres = rng.normal(0, 1, (max(2, n // 12), dim))
    return [(int(i), int(rng.integers(labels)), (centres[rng.integers(len(centres))] * rng.choice([0.1, 1, 3])
             + rng.normal(0, spread, dim)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize(("dim", "tile_bytes"), [(24, 8 << 20), (24, 24 * 8 * 40), (2, 2 * 8 * 30), (1, 8 * 20), (9, 9 * 8 * 3)])
def test_equals_all_pairs_whatever_the_tiles(spark, dim, tile_bytes):
    rng = np.random.default_rng(dim)
    rows = clustered(rng, 600, dim, 3, 0.02)
    rows += [(10_000 + i, 0, rows[0][2]) for i in range(50)] + [(20_000 + i, 1, (np.eye(5)[i % 5] + 0.01).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(cosine.near_duplicates(table.repartition(5), tile_bytes=tile_bytes)) == plain(rows)


def test_chains_over_many_tiles_are_one_component(spark):
    angles = np.arange(0, 3, 0.01)
    rows = [(int(i), 1, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found(cosine.near_duplicates(table, tile_bytes=16 * 25)) == plain(rows)


def test_blocks_larger_than_one_product(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = np.array([v for *_, v in clustered(rng, 500, 16, 1, 0.03)])
    weight = rng.integers(1, 4, 500)
    own = (rng.random(500) < 0.4).astype(int)
    monkeypatch.setattr(cosine, "SIDE", 37)
    u = cosine.unit(vectors)
    close = u @ u.T >= 0.98
    np.fill_diagonal(close, False)
    axes = np.linalg.qr(rng.normal(0, 1, (16, 16)))[0]
    for across in (False, True):
        linked = close & (own[:, None] != own) if across else close
        side = own if across else own * 0
        sums, root = cosine.tile_links(vectors, weight, side, across, axes)
        assert (sums == linked @ weight).all()
        assert all(root[i] == root[j] for i, j in zip(*np.nonzero(linked), strict=True))
        assert len(set(root)) == 500 - np.linalg.matrix_rank(np.diag(linked.sum(1)) - linked.astype(float))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 1, None), (4, 1, [nan, 1.0]),
            (5, 1, [inf, 1.0]), (6, 1, [None, 1.0]), (7, 1, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.1]), (8, 1, []), (9, None, [1.0, 0.0]),
            (10, 2, [1.0, 0.0]), (None, 3, [1.0, 0.0]), (None, None, None), (11, 1, [1e200, 1e190]), (12, 1, [-1.0, 0.0]),
            (13, 4, [5e-324, 0.0]), (14, 4, [1e300, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, node string, n int")
    assert found(cosine.near_duplicates(table)) == plain(rows)
    assert cosine.near_duplicates(table.where("vec_id < 0")).count() == 0
    assert found(cosine.near_duplicates(table.where("vec_id = 3"))) == [(3, 0, 3, True)]
