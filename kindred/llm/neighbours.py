"""Approximate nearest neighbours by counting collisions on single projections.

Every vector lies in a cell, that of the nearest of some sampled vectors (at most ``PIVOTS``; the sample shapes the
cells only, every vector is in one). Cells are cut into blocks of bounded size. Each block of vectors keeps its
places on ``projections`` random lines as sorted arrays. A query opens a window around its own place on every line
and widens all of them step by step (virtual rehashing: the arrays stay as they are). A vector that lies in the
windows of ``threshold`` lines or more is verified by its exact distance. The search of a block ends when the windows
are so wide that a vector as near as the k-th best found would already have been counted, save for a chance of about
one in 700.

A query first searches one block of its own cell. Its k-th distance there bounds the windows it needs elsewhere, and
of the other blocks it goes to those only whose extent on enough lines reaches into these windows: in any other no
vector can have the collisions. So vectors in clusters are met by the queries near them; where nothing is clustered
(distances all alike, as in high dimensions) no block can be left out and the work is queries times vectors.

Blocks and groups of queries have bounded sizes and meet pairwise, so no task holds more than one block of each.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
with a null id; a query meets only vectors of its own length; candidates with the query's id are left out; rows that
repeat an id count once, at their smallest distance (a repeated query id uses the smallest vector); ties go to the
smaller id; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from kindred.session import settle

K = 10
PROJECTIONS = 48
THRESHOLD = 0.7
WIDEN = 1.3
BLOCK = 8192
QUERY_BLOCK = 1024
PIVOTS = 1024
EXTENTS = 4096
SEED = 20240229

HOME = ["dim", "cell", "sub"]


def usable(embeddings: DataFrame) -> DataFrame:
    kind = embeddings.schema["embedding"].dataType
    vector = F.col("embedding")
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)):
        vector = vector.cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def random_lines(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim, projections]).standard_normal((dim, projections))


def reach_of(projections: int, threshold: float) -> float:
    """Windows of this many times a distance hold such a vector on enough lines, three deviations to spare."""
    spare = 3 * math.sqrt(threshold * (1 - threshold) / projections)
    return NormalDist().inv_cdf((1 + min(0.995, threshold + spare)) / 2)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                 bounds: np.ndarray | None = None, projections: int = PROJECTIONS, threshold: float = THRESHOLD,
                 widen: float = WIDEN):
    """Per query the ids and distances of the nearest verified vectors of one block, none beyond the query's bound."""
    count, dim = vectors.shape
    lines = random_lines(dim, projections)
    placed = (vectors @ lines).T
    order = np.argsort(placed, axis=1, kind="stable").astype(np.int32)
    places = np.take_along_axis(placed, order, axis=1)
    centres = queries @ lines
    needed = math.ceil(threshold * projections)
    reach = reach_of(projections, threshold)
    spread = float(np.median(np.ptp(places, axis=1))) or 1.0
    # All lines end to end, so that one search finds the edges of all windows.
    least, most = places.min() - spread, places.max() + spread
    starts = np.arange(projections) * count
    shift = np.arange(projections) * (most - least + spread)
    joined, flat = (places + shift[:, None]).ravel(), order.ravel()
    if bounds is None:
        bounds = np.full(len(queries), np.inf)
    for query, centre, own_id, bound in zip(queries, centres, query_ids, bounds, strict=True):
        hits = np.zeros(count, np.int32)
        known = np.zeros(count, bool)
        distance = np.full(count, np.inf)
        low = high = np.searchsorted(joined, np.clip(centre, least, most) + shift)
        half = spread / 64
        if np.isfinite(bound):
            half = max(half, reach * bound / widen ** 2)
        while True:
            a = np.minimum(np.searchsorted(joined, np.clip(centre - half, least, most) + shift, "left"), low)
            b = np.maximum(np.searchsorted(joined, np.clip(centre + half, least, most) + shift, "right"), high)
            parts = [flat[x:y] for x, y in zip([*a, *high], [*low, *b], strict=True)]
            low, high = a, b
            hits += np.bincount(np.concatenate(parts), minlength=count).astype(np.int32)
            new = np.flatnonzero((hits >= needed) & ~known)
            known[new] = True
            apart = vectors[new] - query
            distance[new] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            others = distance[known & (ids != own_id)]
            kth = np.partition(others, k - 1)[k - 1] if len(others) >= k else np.inf
            if half >= reach * min(kth, bound) or (high - low).min() >= count:
                break
            half *= widen
        own = np.flatnonzero(known & (ids != own_id) & (distance <= bound * (1 + 1e-9)))
        distance[own] = distances(vectors[own], query)
        own = own[np.lexsort((ids[own], distance[own]))]
        _, first = np.unique(ids[own], return_index=True)
        own = own[np.sort(first)][:k]
        yield own_id, ids[own], distance[own]


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each row with its ``dim``, the ``cell`` of its nearest pivot (0 without any of its length) and a running ``salt``."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches):
        seen = 0
        for batch in batches:
            dims = batch["embedding"].map(len).to_numpy()
            cells = np.zeros(len(batch), np.int32)
            for dim in np.unique(dims):
                near = held.value.get(int(dim))
                if near is not None and len(near) > 1:
                    at = np.flatnonzero(dims == dim)
                    cells[at] = np.argmin((near ** 2).sum(axis=1) - 2 * matrix(batch["embedding"].iloc[at]) @ near.T, axis=1)
            yield batch.assign(dim=dims.astype(np.int32), cell=cells, salt=np.arange(seen, seen + len(batch)))
            seen += len(batch)

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInPandas(place, f"vec_id long, embedding {kind}, dim int, cell int, salt long")


def in_groups(asked: DataFrame, query_block: int) -> tuple[DataFrame, DataFrame]:
    """Queries with a ``group`` of bounded size within their block, and how many groups each block has."""
    groups = asked.groupBy(*HOME).agg(F.ceil(F.count("*") / query_block).cast("int").alias("groups"))
    return asked.join(groups, HOME).withColumn(
        "group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups"), groups


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance) for every query vector."""
    rows = usable(embeddings)
    wanted_pivots = min(PIVOTS, -(-rows.count() // block))
    pivots: dict[int, list] = {}
    for row in rows.select("embedding").orderBy(F.xxhash64("vec_id"), "embedding").limit(wanted_pivots).collect():
        pivots.setdefault(len(row[0]), []).append(row[0])
    pivots = {dim: np.array(found, np.float64) for dim, found in pivots.items()}

    placed = settle(in_cells(rows, pivots), "cells")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of_block = F.pmod("salt", F.coalesce("blocks", F.lit(1))).cast("int").alias("sub")
    blocks = placed.join(sizes, ["dim", "cell"]).select(*HOME[:2], of_block, "vec_id", "embedding")
    once = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = settle(in_cells(once, pivots).join(sizes, ["dim", "cell"], "left").select(
        *HOME[:2], of_block, F.col("vec_id").alias("query_id"), "embedding"), "queries")

    def every(groups):
        return F.explode(F.sequence(F.lit(0), groups - 1)).alias("group")

    def search(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(vectors) and len(wanted):
            bounds = wanted["bound"].to_numpy() if "bound" in wanted else None
            for q, ids, scores in search_block(
                    matrix(vectors["embedding"]), vectors["vec_id"].to_numpy(), matrix(wanted["embedding"]),
                    wanted["query_id"].to_numpy(), k, bounds):
                out.append((np.full(len(ids), q), ids, scores))
        columns = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns, strict=True)))

    found_type = "query_id long, vec_id long, score double"

    def at_home(key, vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = search(vectors, wanted).assign(low=None, high=None)
        if len(vectors) and key[3] == 0:
            # One row without a query carries the extent of the block on every line.
            held = matrix(vectors["embedding"]) @ random_lines(key[0])
            found = found.astype({"query_id": "Int64", "vec_id": "Int64"}).reindex(range(len(found) + 1))
            found.at[len(found) - 1, "low"] = held.min(axis=0)
            found.at[len(found) - 1, "high"] = held.max(axis=0)
        return found.assign(dim=key[0], cell=key[1], sub=key[2])

    keys = [*HOME, "group"]
    ask, groups = in_groups(asked, query_block)
    base = blocks.join(groups, HOME, "left").select(
        *HOME, "vec_id", "embedding", every(F.coalesce("groups", F.lit(1))))
    home = settle(base.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(
        at_home, f"{found_type}, low array<double>, high array<double>, dim int, cell int, sub int"), "home")
    extents = home.where(F.col("low").isNotNull()).select(*HOME, "low", "high")
    found = home.where(F.col("low").isNull()).select("query_id", "vec_id", "score")

    # Queries and extents meet in groups; what comes out names the blocks a query still has to search.
    kth = found.groupBy("query_id").agg(F.max("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k)
    n_groups = max(1, -(-asked.count() // query_block))
    n_parts = max(1, -(-extents.count() // EXTENTS))
    bounded = asked.join(kth.drop("n"), "query_id", "left").select(
        "query_id", "embedding", *HOME, F.coalesce("bound", F.lit(float("inf"))).alias("bound"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int").alias("group"), F.explode(F.sequence(
            F.lit(0), F.lit(n_parts - 1))).alias("part"))
    parts = extents.withColumn("part", F.pmod(F.xxhash64("cell", "sub"), F.lit(n_parts)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    needed, reach = math.ceil(THRESHOLD * PROJECTIONS), reach_of(PROJECTIONS, THRESHOLD)

    def opened(key, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32))]
        if len(wanted) and len(held):
            low, high = matrix(held["low"]), matrix(held["high"])
            cells, subs = held["cell"].to_numpy(), held["sub"].to_numpy()
            centres = matrix(wanted["embedding"]) @ random_lines(key[0])
            own = wanted[["query_id", "bound", "cell", "sub"]].itertuples(index=False, name=None)
            for centre, (q, bound, cell, sub) in zip(centres, own, strict=True):
                half = reach * bound * (1 + 1e-9)
                lines = ((low <= centre + half) & (high >= centre - half)).sum(axis=1)
                go = (lines >= needed) & ~((cells == cell) & (subs == sub))
                out.append((np.full(go.sum(), q), np.full(go.sum(), bound), cells[go], subs[go]))
        columns = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame(dict(zip(["query_id", "bound", "cell", "sub"], columns, strict=True))).assign(dim=key[0])

    meeting = ["dim", "group", "part"]
    pairs = settle(bounded.groupBy(*meeting).cogroup(parts.groupBy(*meeting)).applyInPandas(
        opened, "query_id long, bound double, cell int, sub int, dim int"), "opened")

    ask, groups = in_groups(pairs.join(asked.select("query_id", "embedding"), "query_id"), query_block)
    base = blocks.join(groups, HOME).select(*HOME, "vec_id", "embedding", every(F.col("groups")))
    more = base.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(search, found_type)

    best = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
