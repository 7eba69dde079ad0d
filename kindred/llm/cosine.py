"""Near-duplicate vectors of one label, by tiles compared along principal axes.

Equal vectors of a label become one class first, so copies are neither compared nor joined with each other. The classes'
unit vectors are turned onto their principal axes (second moments summed over all of them; the axes decide only how
early a comparison ends, never its result). A tile pair is compared a few leading axes at a time: the products so far
plus the product of the norms of what remains bound the cosine from above, and pairs whose bound is below the threshold
drop out; what is left at the end is checked with the original vectors in double precision.

A label whose classes fit one tile (``TILE_BYTES``) is one group. A larger one is laid on a grid of the two axes of most
variance, with cells as wide as two linked unit vectors can be apart, so only neighbouring cells meet; a cell that is
still too large is cut into tiles by a hash, and the tiles of two neighbouring cells meet in pairs, in a task of their own.
Pairs exist only inside a task: what leaves it is, for each class, how many vectors it is linked with and one link that
keeps its component together. Work in a dense cell grows with the square of its classes.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links
with nothing and is its own component; vectors of different lengths do not link; rows that repeat an id or a vector are
vectors of their own; a null id takes part but names no component (one without any other id has a null
``component_id``, and its rows are not kept); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.session import settle

THRESHOLD = 0.98
TILE_BYTES = 8 << 20
SIDE = 1024
# Axes compared before the bounds are looked at, and how much is added each time.
STEP = 8
SLACK = 1e-9
# Above this share of live pairs a block is multiplied whole.
DENSE = 0.05


def marked(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` and ``node``: the name of the row's class, null if it cannot link."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                             vector.alias("vector"))
    fits = (F.col("label").isNotNull() & F.col("vector").isNotNull()
            & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    name = F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (
        F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "vector", "label"))))
    return rows.withColumn("node", F.when(fits, name))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def principal_axes(classes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The axes (columns, most second moment first) of all unit vectors of ``dim`` values, and the variance on each.

    Tasks add up products, rows of the sum meet in order of their number; ``dim`` x ``dim`` values reach the driver.
    """
    def moments(batches):
        total, count = np.zeros((dim + 1, dim)), 0
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column(0), dim))
                total[:dim] += u.T @ u
                total[dim] += u.sum(axis=0)
                count += len(u)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim + 1), pa.int32()), pa.array([count] * (dim + 1)), pa.array([r.tobytes() for r in total])],
                names=["at", "n", "sums"])

    def add(batches):
        now, n, held = None, 0, None
        out = []
        for b in batches:
            for at, count, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != now:
                    if held is not None:
                        out.append((now, n, held.tobytes()))
                    now, n, held = at, 0, np.zeros(dim)
                n += count
                held += np.frombuffer(sums)
        if held is not None:
            out.append((now, n, held.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out]), pa.array([r[2] for r in out])],
                names=["at", "n", "sums"])

    fields = "at int, n long, sums binary"
    parts = classes.where(F.size("vector") == dim).select("vector").mapInArrow(moments, fields)
    total, count = np.zeros((dim + 1, dim)), 1
    for row in parts.repartition("at").sortWithinPartitions("at").mapInArrow(add, fields).toLocalIterator():
        total[row.at], count = np.frombuffer(row.sums), row.n
    values, axes = np.linalg.eigh(total[:dim] / count)
    values, axes = values[::-1], axes[:, ::-1].copy()
    return axes, values - (total[dim] / count @ axes) ** 2


def near(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, rest_x: np.ndarray, rest_y: np.ndarray,
         threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs with a cosine of at least ``threshold``.

    ``x``, ``y``: unit vectors on their axes; ``ux``, ``uy``: the same as given; ``rest_x[k]``: norms from axis ``k * STEP``.
    """
    dim, least = x.shape[1], threshold - SLACK
    products = np.zeros((len(x), len(y)))
    for k, at in enumerate(range(0, dim, STEP), 1):
        products += x[:, at:at + STEP] @ y[:, at:at + STEP].T
        live = products + rest_x[k][:, None] * rest_y[k] >= least
        left = np.count_nonzero(live)
        if not left:
            return (np.empty(0, np.int64),) * 2
        if left <= DENSE * live.size:
            break
    else:
        return np.nonzero(ux @ uy.T >= threshold)
    r, c = np.nonzero(live)
    s = products[r, c]
    for k, at in enumerate(range(at + STEP, dim, STEP), k + 1):
        s += np.einsum("ij,ij->i", x[r, at:at + STEP], y[c, at:at + STEP])
        live = s + rest_x[k][r] * rest_y[k][c] >= least
        r, c, s = r[live], c[live], s[live]
    exact = np.einsum("ij,ij->i", ux[r], uy[c]) >= threshold
    return r[exact], c[exact]


def tile_links(vectors: np.ndarray, weight: np.ndarray, own: np.ndarray, across: bool, axes: np.ndarray | None,
               threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """For every vector of a tile pair the summed weight of those it is linked with, and the first of its component.

    ``own``: the side each vector is of (0, 1); only pairs ``across`` the sides count, or all pairs of the one side.
    """
    u = unit(vectors)
    x = u if axes is None else u @ axes
    # In the order of the leading axis, blocks far apart on it cannot hold a link.
    order = np.lexsort((x[:, 0], own))
    u, x = u[order], x[order]
    squares = np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1]
    rest = [np.sqrt(squares[:, at]) if at < x.shape[1] else np.zeros(len(x)) for at in range(0, x.shape[1] + STEP, STEP)]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    cut = int(np.count_nonzero(own == 0)) if across else len(x)
    sums = np.zeros(len(x), np.int64)
    root = np.arange(len(x))
    weights = weight[order]
    for a in range(0, cut, SIDE):
        p = slice(a, min(a + SIDE, cut))
        for b in range(cut if across else a, len(x), SIDE):
            q = slice(b, min(b + SIDE, len(x)))
            if x[q.start, 0] - x[p.stop - 1, 0] > reach or x[p.start, 0] - x[q.stop - 1, 0] > reach:
                continue
            r, c = near(x[p], x[q], u[p], u[q], [n[p] for n in rest], [n[q] for n in rest], threshold)
            r, c = r + p.start, c + q.start
            if p == q:
                r, c = r[r < c], c[r < c]
            np.add.at(sums, r, weights[c])
            np.add.at(sums, c, weights[r])
            _join(root, r, c)
    back = np.empty(len(x), np.int64)
    back[order] = np.arange(len(x))
    return sums[back], order[root][back]


def _join(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Ties the components of ``r`` and ``c`` together; ``root`` always points straight at a component's first."""
    r, c = root[r], root[c]
    while len(r):
        np.minimum.at(root, np.maximum(r, c), np.minimum(r, c))
        while (root[root] != root).any():
            root[:] = root[root]
        r, c = root[r], root[c]
        r, c = r[r != c], c[r != c]


def tiles(classes: DataFrame, axes: np.ndarray, wide: np.ndarray, threshold: float, tile_bytes: int) -> DataFrame:
    """The classes with the tile pairs they are compared in: ``label``, ``dim``, ``tile``, whether only pairs
    ``across`` its two sides count, the side (``own``), ``node``, ``n``, ``vector``."""
    rows = classes.select("label", F.size("vector").alias("dim"), "node", "n", "vector")
    room = F.lit(tile_bytes) / (8 * F.col("dim"))
    whole = [F.lit("").alias("tile"), F.lit(False).alias("across"), F.lit(0).alias("own"), "node", "n", "vector"]
    crowded = settle(rows.groupBy("label", "dim").agg(F.count("*").alias("rows")).where(F.col("rows") > room).drop("rows"),
                     "crowded")
    if crowded.isEmpty():
        return rows.select("label", "dim", *whole)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    sent = classes.sparkSession.sparkContext.broadcast(axes[:, np.argsort(-wide)[:2]])

    def place(batches):
        lines = sent.value
        for b in batches:
            cells = np.zeros((b.num_rows, 2), np.int32)
            sizes = b.column(1).to_numpy()
            # Vectors of another length have axes of their own: they share one cell.
            at = np.flatnonzero(sizes == len(lines))
            if len(at):
                u = unit(matrix(b.column(4).take(pa.array(at)), len(lines)))
                cells[at, :lines.shape[1]] = np.floor(u @ lines / reach)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])],
                                             names=[*b.schema.names, "c1", "c2"])

    small = rows.join(crowded, ["label", "dim"], "left_anti").select("label", "dim", *whole)
    placed = rows.join(crowded, ["label", "dim"], "left_semi").mapInArrow(
        place, "label string, dim int, node string, n long, vector array<double>, c1 int, c2 int")
    cells = settle(placed.groupBy("label", "dim", "c1", "c2").agg(F.count("*").alias("rows")).select(
        "label", "dim", "c1", "c2", F.ceil(F.col("rows") / room).cast("int").alias("blocks")), "cells")
    # Each pair of neighbouring cells once; a cell is its own neighbour.
    steps = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    there = cells.select("label", "dim", F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("blocks").alias("others"))
    pairs = cells.withColumn("step", F.explode(steps)).select(
        "label", "dim", "c1", "c2", "blocks", (F.col("c1") + F.col("step.x")).alias("d1"),
        (F.col("c2") + F.col("step.y")).alias("d2")).join(there, ["label", "dim", "d1", "d2"])
    name = F.concat_ws(",", "c1", "c2", "d1", "d2")
    same = (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))
    first = pairs.select("label", "dim", "c1", "c2", name.alias("pair"), same.alias("same"), F.lit(0).alias("own"), "others")
    second = pairs.where(~same).select("label", "dim", F.col("d1").alias("c1"), F.col("d2").alias("c2"), name.alias("pair"),
                                       F.lit(False).alias("same"), F.lit(1).alias("own"), F.col("blocks").alias("others"))
    meets = first.unionByName(second).groupBy("label", "dim", "c1", "c2").agg(
        F.collect_list(F.struct("pair", "same", "own", "others")).alias("meets"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = placed.join(cells, ["label", "dim", "c1", "c2"]).withColumn("block", mine).join(
        meets, ["label", "dim", "c1", "c2"]).withColumn("meet", F.explode("meets")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("meet.others") - 1)))
    left = F.when(F.col("meet.same"), F.least("block", "other")).when(F.col("meet.own") == 0, F.col("block")).otherwise(F.col("other"))
    right = F.when(F.col("meet.same"), F.greatest("block", "other")).when(F.col("meet.own") == 0, F.col("other")).otherwise(F.col("block"))
    own = F.when(F.col("meet.same"), (F.col("block") > F.col("other")).cast("int")).otherwise(F.col("meet.own"))
    return small.unionByName(spread.select(
        "label", "dim", F.concat_ws(",", "meet.pair", left, right).alias("tile"),
        (~F.col("meet.same") | (left != right)).alias("across"), own.alias("own"), "node", "n", "vector"))


def linked(classes: DataFrame, threshold: float, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``node``, ``links`` (vectors it is linked with in a tile pair) and ``root`` (a class of the same component)."""
    common = classes.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return classes.select("node", F.col("n").alias("links"), F.col("node").alias("root"))
    axes, variance = principal_axes(classes, common.dim)
    sent = classes.sparkSession.sparkContext.broadcast(axes)

    def compare(tile: pa.Table) -> pa.Table:
        dim = tile["dim"][0].as_py()
        own = tile["own"].to_numpy()
        lines = sent.value if len(sent.value) == dim else None
        sums, first = tile_links(
            matrix(tile["vector"], dim), tile["n"].to_numpy(), own, tile["across"][0].as_py(), lines, threshold)
        found = pa.array(np.flatnonzero(sums))
        return pa.table({"node": tile["node"].take(found), "links": pa.array(sums[sums > 0]),
                         "root": tile["node"].take(pa.array(first[sums > 0]))})

    placed = tiles(classes, axes, variance, threshold, tile_bytes)
    return placed.groupBy("label", "dim", "tile").applyInArrow(compare, "node string, links long, root string")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    rows = marked(embeddings)
    classes = settle(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"),
        F.min("vec_id").alias("least")), "classes")
    links = settle(linked(classes, threshold, tile_bytes), "links")
    roots = components(links.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = links.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node").join(
        classes.select("node", "least"), "node")
    names = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(names, "root").select("node", "links", "component_id")
    by_class = classes.select("node", "n", "least").join(known, "node", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "node").join(by_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def oracle() -> str:
    """All pairs of a label, and the closure of the links, in SQL."""
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fit AS MATERIALIZED (
      SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
      SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM least LEFT JOIN counts USING (vec_id)"""
