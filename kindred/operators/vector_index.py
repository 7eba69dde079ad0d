"""A stored inverted-file index: the vectors of each location in trained cells, searched cell by cell.

Built once: cells are trained per location on a bounded sample, every vector is put into its nearest cell, and cells
are stored side by side with how far their vectors reach. A search compares a user with the cells of its location,
reads the nearest ones and ranks their vectors by exact cosine; it needs no cap on a location's candidates. With
``exact`` it then also reads every cell that may still hold something better than what was found: no vector of a cell is
nearer to the user than the angle to the cell less the cell's reach.

Users come in blocks of one location and meet its stored vectors in chunks of whole cells (of parts of a very large
cell), both bounded in values. User x cell and user x vector pairs exist only inside a task; a user leaves it as one row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.operators.similarity import NO_LOCATION, _flat, _matrix, _top_k, _unit, top_k_by_cosine, vector_reason
from kindred.operators.skew import heavy_keys
from kindred.session import settle

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors of a location that cells are trained on, at most.
SAMPLE = 65_536
ROUNDS = 12
SLOTS = 64
# Cells that a search may name one by one in a filter; more meet the stored rows in a join.
NAMED_CELLS = 1000
SLACK = 1e-9
# Values of vectors in a block of users and in a chunk of stored rows, and scores a task holds at once.
BLOCK_VALUES = 1 << 20
CHUNK_VALUES = 1 << 22
SCORES = 1 << 20
LEAST_ROWS = 1024


def _train(location: list[str], cells: int | None):
    def train(rows: pa.Table) -> pa.Table:
        vectors = np.stack([np.asarray(v, dtype=np.float64) for v in rows["vector"].to_pylist()])
        length = np.linalg.norm(vectors, axis=1)
        vectors = vectors[length > 0] / length[length > 0, None]
        # In the order of a hash the first rows are a random choice.
        vectors = vectors[np.argsort(rows["chance"].to_numpy()[length > 0], kind="stable")]
        total = rows["total"][0].as_py()
        centres = np.unique(vectors[:min(len(vectors), cells or max(1, round(math.sqrt(total))))], axis=0)
        for _ in range(ROUNDS):
            own = np.argmax(vectors @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, vectors)
            size = np.linalg.norm(sums, axis=1)
            centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
        n = len(centres)
        return pa.table({**{c: pa.array([rows[c][0].as_py()] * n, pa.string()) for c in location},
                         "number": pa.array(range(n), pa.int32()), "vector": pa.array(list(centres), pa.list_(pa.float64()))})
    return train


def build(
    candidates: DataFrame, index: DataFrame, dim: int, path: str, fields: Sequence[str],
    location: Sequence[str] = ("city", "timezone"), cells: int | None = None, sample: int = SAMPLE, slots: int = SLOTS,
) -> None:
    """Train and store the index of ``candidates`` (location and ``fields``, the first one the id) under ``path``.

    ``index``: that id and ``vector``. ``cells`` per location: by default the root of its vectors. Candidates without a
    location or a usable vector are left out. ``sample`` bounds what cells are trained on, every vector is stored.
    """
    location, fields = list(location), list(fields)
    usable = index.select(fields[0], "vector").filter(vector_reason(F.col("vector"), dim).isNull())
    rows = settle(candidates.dropna(subset=location).select(
        *[F.col(c).cast("string").alias(c) for c in location], *fields).join(usable, fields[0]), "indexed")
    chance = F.xxhash64(fields[0])
    sizes = rows.groupBy(*location).agg(F.count(F.lit(1)).alias("total"))
    # About ``sample`` rows of a location, without ranking its rows.
    chosen = rows.join(sizes, location).filter(F.pmod(chance, F.col("total")) < sample).select(
        *location, "vector", "total", chance.alias("chance"))
    named = ", ".join(f"`{c}` string" for c in location)
    trained = settle(chosen.groupBy(*location).applyInArrow(
        _train(location, cells), f"{named}, number int, vector array<double>").withColumn(
        "cell", F.concat_ws("\u0001", *location, "number")), "cells")
    placed = top_k_by_cosine(
        rows, trained.select(*location, "cell"), trained.select("cell", "vector"), dim, location, fields[0],
        keep=[fields[0]], fields=["cell"], k=1)
    nearest = settle(placed.select(fields[0], F.col("matches")[0]["cell"].alias("cell"),
                                   F.col("matches")[0]["match_score"].alias("inside")).filter("cell IS NOT NULL"), "placed")
    reach = nearest.groupBy("cell").agg(F.min("inside").alias("inside"), F.count(F.lit(1)).alias("rows"))
    trained.join(reach, "cell").select(*location, "cell", "vector", "inside", "rows").write.parquet(f"{path}/cells")
    (rows.join(nearest.select(fields[0], "cell"), fields[0]).withColumn("slot", slot("cell", slots))
     .repartition("slot").sortWithinPartitions("slot", "cell").write.partitionBy("slot").parquet(f"{path}/lists"))


def slot(cell: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(slots)).cast("int")


def _lists(spark: SparkSession, path: str, wanted: DataFrame, slots: int) -> DataFrame:
    """The stored vectors of the ``wanted`` cells: a few are named in the scan's filters, many are joined."""
    stored = spark.read.parquet(f"{path}/lists")
    few = wanted.limit(NAMED_CELLS + 1).select("cell", slot("cell", slots).alias("slot")).collect()
    if len(few) > NAMED_CELLS:
        return stored.join(wanted, "cell", "left_semi")
    return stored.filter(F.col("slot").isin(sorted({r.slot for r in few})) & F.col("cell").isin([r.cell for r in few]))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _products(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores rounded as in the search of a whole location; a row or column alone would be summed in another order."""
    n, m = len(rows), columns.shape[1]
    return np.round((rows if n > 1 else np.repeat(rows, 2, axis=0)) @ (
        columns if m > 1 else np.repeat(columns, 2, axis=1)), 12)[:n, :m]


def _edges(loc: list[str], dim: int, key: str, k: int, probes: float, exact: bool):
    """Per user the last of its nearest cells (``edge`` and ``edge_cell``); on a block's first row the cells to read."""
    def order(users: pa.Table, cells: pa.Table) -> pa.Table:
        rows, vectors = _matrix(users["vector"], dim)
        cells = cells.sort_by("cell")
        n = cells.num_rows if len(rows) else 0
        kept = users.select([*loc, "_block", key, "vector"]).take(pa.array(rows if n else rows[:0], type=pa.int64()))
        if not n:
            return kept.append_column("edge", pa.array([], pa.float64())).append_column(
                "edge_cell", pa.array([], pa.string())).append_column("wanted", pa.array([], pa.list_(pa.string())))
        _, centres = _matrix(cells["vector"], dim)
        names = cells["cell"].to_numpy(zero_copy_only=False)
        reach, sizes = _angle(cells["inside"].to_numpy()), cells["rows"].to_numpy()
        centres, first = _unit(centres).T, max(1, math.ceil(n * probes))
        edge, last, wanted = np.empty(len(rows)), np.empty(len(rows), dtype=np.int64), np.zeros(n, dtype=bool)
        step = max(1, SCORES // n)
        for at in range(0, len(rows), step):
            scores = _products(_unit(vectors[at:at + step]), centres)
            nearest = np.argsort(-scores, axis=1, kind="stable")
            own = np.arange(len(scores))
            last[at:at + step] = nearest[:, first - 1]
            edge[at:at + step] = scores[own, nearest[:, first - 1]]
            wanted[np.unique(nearest[:, :first])] = True
            if exact:
                # Whole cells that surely lie within an angle hold k vectors: no cell beyond it matters.
                angle = _angle(scores)
                far = np.cos(np.minimum(math.pi, angle + reach))
                by_far = np.argsort(-far, axis=1, kind="stable")
                enough = np.cumsum(sizes[by_far], axis=1) >= k
                at_least = np.where(enough.any(axis=1), far[own, by_far[own, enough.argmax(axis=1)]], -np.inf)
                wanted |= (np.cos(np.maximum(0.0, angle - reach)) >= at_least[:, None] - SLACK).any(axis=0)
        read = [names[wanted].tolist()] + [None] * (len(rows) - 1)
        return kept.append_column("edge", pa.array(edge)).append_column(
            "edge_cell", pa.array(names[last], pa.string())).append_column("wanted", pa.array(read, pa.list_(pa.string())))
    return order


def _ranked(dim: int, key: str, fields: list[str], k: int, exact: bool):
    """``key`` and its ``k`` best in one chunk of cells: the vectors of its nearest cells, and with ``exact`` then
    those of every cell that can still hold a better one."""
    def rank(users: pa.Table, stored: pa.Table) -> pa.Table:
        # By id, so that equal scores come in its order.
        stored = stored.sort_by(fields[0])
        kept, vectors = _matrix(stored["vector"], dim)
        n, rows = len(kept), np.arange(users.num_rows)
        _, asking = _matrix(users["vector"], dim)
        coded = _flat(stored["cell"]).take(pa.array(kept, type=pa.int64())).dictionary_encode()
        names, cell = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        firsts = np.zeros(len(names), dtype=np.int64)
        firsts[cell[::-1]] = kept[::-1]
        _, centres = _matrix(stored["centre"].take(pa.array(firsts, type=pa.int64())), dim)
        reach = _angle(stored["inside"].to_numpy()[firsts])
        vectors, centres, names = _unit(vectors).T, _unit(centres).T, np.array(names, dtype=object)
        edge, edge_cell = users["edge"].to_numpy(), users["edge_cell"].to_numpy(zero_copy_only=False)
        u_parts, c_parts, s_parts = [], [], []
        step = max(2, SCORES // max(n, 1))
        for at in range(0, len(rows) if n else 0, step):
            own = _unit(asking[at:at + step])
            to_cell = _products(own, centres)
            scores = np.full((len(own), n), -np.inf)

            def look(wanted: np.ndarray, own=own, scores=scores) -> None:
                who, which = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0)[cell])
                if len(who):
                    some = _products(own[who], vectors[:, which])
                    place = np.ix_(who, which)
                    scores[place] = np.where(wanted[np.ix_(who, cell[which])], some, scores[place])

            limit = edge[at:at + step, None]
            near = (to_cell > limit) | ((to_cell == limit) & (names[None, :] <= edge_cell[at:at + step, None]))
            look(near)
            if exact:
                kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(own), -np.inf)
                best = np.cos(np.maximum(0.0, _angle(to_cell) - reach))
                look(~near & (best >= kth[:, None] - SLACK))
            found, cols = _top_k(scores, k)
            u_parts.append(at + found)
            c_parts.append(kept[cols])
            s_parts.append(scores[found, cols])
        u_idx = np.concatenate(u_parts) if u_parts else np.empty(0, dtype=np.int64)
        c_idx = np.concatenate(c_parts) if c_parts else np.empty(0, dtype=np.int64)
        s_val = np.concatenate(s_parts) if s_parts else np.empty(0)
        picked = stored.select(fields).take(pa.array(c_idx, type=pa.int64()))
        structs = pa.StructArray.from_arrays(
            [_flat(picked[f]) for f in fields] + [pa.array(s_val, type=pa.float64())], names=[*fields, "match_score"])
        offsets = pa.array(np.searchsorted(u_idx, np.arange(len(rows) + 1)).astype(np.int32))
        return users.select([key]).append_column("matches", pa.ListArray.from_arrays(offsets, structs))
    return rank


def search(
    spark: SparkSession, users: DataFrame, path: str, dim: int, fields: Sequence[str], k: int = 20, probes: float = 0.8,
    exact: bool = False, location: Sequence[str] = ("city", "timezone"), user_key: str = "user_id", slots: int = SLOTS,
) -> DataFrame:
    """One row per user: ``user_key`` and ``matches``, best first, as :func:`top_k_by_cosine` gives them.

    ``probes``: the share of a location's cells that is read for a user, nearest first; the default finds 95 % of the 20 best
    among vectors without clusters, clustered ones need far less. ``exact`` goes on to all
    cells that can hold a better one. Users without a location, a usable vector or a candidate get an empty array.
    """
    location, fields = list(location), list(fields)
    cells = spark.read.parquet(f"{path}/cells")
    if cells.isEmpty():
        raise ValueError("the index holds no vector")
    block_rows, chunk_rows = (max(LEAST_ROWS, n // dim) for n in (BLOCK_VALUES, CHUNK_VALUES))
    loc = [f"_{c}" for c in location]
    where = [F.coalesce(F.col(c).cast("string"), F.lit(NO_LOCATION)).alias(f"_{c}") for c in location]
    fits = F.size("vector") == dim
    asking = settle(users.select(*where, user_key, "vector").filter(fits), "asking")
    # Blocks of users; every block of a location meets all its cells.
    crowded = heavy_keys(asking, loc, block_rows, "crowded")
    blocks = cells.select(*where, "cell", "vector", "inside", "rows")
    if crowded is None:
        asking, blocks = asking.withColumn("_block", F.lit(0)), blocks.withColumn("_block", F.lit(0))
    else:
        crowded = crowded.select(*loc, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
        many = F.coalesce(F.col("_blocks"), F.lit(1))
        asking = asking.join(crowded, loc, "left").withColumn(
            "_block", F.pmod(F.xxhash64(user_key), many).cast("int")).drop("_blocks")
        blocks = blocks.join(crowded, loc, "left").withColumn(
            "_block", F.explode(F.sequence(F.lit(0), many - 1))).drop("_blocks")
    types = dict(asking.dtypes)
    places = ", ".join(f"`{c}` string" for c in loc) + ", _block int"
    schema = f"{places}, `{user_key}` {types[user_key]}, vector {types['vector']}, edge double, edge_cell string"
    order = settle(asking.groupBy(*loc, "_block").cogroup(blocks.groupBy(*loc, "_block")).applyInArrow(
        _edges(loc, dim, user_key, k, probes, exact), f"{schema}, wanted array<string>"), "order")
    wanted = settle(order.select(*loc, "_block", F.explode("wanted").alias("cell")), "wanted")
    # Chunks of a location's cells; a cell that is larger than a chunk is dealt into parts.
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / chunk_rows)).cast("int")
    units = cells.select(*where, "cell", F.col("vector").alias("centre"), "inside", parts.alias("_parts"),
                         (F.col("rows") / parts).alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    before = F.sum("_n").over(Window.partitionBy(*loc).orderBy("cell", "_part")) - F.col("_n")
    units = units.withColumn("_chunk", F.floor(before / chunk_rows).cast("int")).drop("_n")
    lists = _lists(spark, path, wanted.select("cell").distinct(), slots)
    lists = lists.select("cell", *fields).join(lists.select(fields[0], "vector"), fields[0])
    wide = wanted.join(units, [*loc, "cell"])
    sent = lists.withColumn("_of", F.xxhash64(fields[0], F.lit("part"))).join(wide, "cell").filter(
        F.pmod("_of", F.col("_parts")) == F.col("_part")).select(*loc, "_block", "_chunk", "cell", "centre", "inside", *fields, "vector")
    chunks = settle(wide.select(*loc, "_block", "_chunk").distinct(), "chunks")
    asked = order.drop("wanted").join(chunks, [*loc, "_block"])
    # Rows that share a key are one user: each of them asks for all of them.
    repeated = heavy_keys(asking, [user_key], 1, "repeated")
    if repeated is not None:
        asked = asked.join(repeated, user_key, "left").withColumn(
            "_n", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("_n"), F.lit(1)).cast("int")))).drop("_n")
    field_type = dict(lists.dtypes)
    struct = ", ".join([f"`{f}`: {field_type[f]}" for f in fields] + ["match_score: double"])
    group = [*loc, "_block", "_chunk"]
    found = asked.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(
        _ranked(dim, user_key, fields, k, exact), f"`{user_key}` {types[user_key]}, matches array<struct<{struct}>>")
    # Best first, ties by id, as in the search of a whole location.
    best_first = F.transform("matches", lambda m: F.struct((-m["match_score"]).alias("_s"), m[fields[0]].alias("_id"), m.alias("m")))
    top = found.withColumn("matches", best_first).groupBy(user_key).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("matches"))), 1, k).alias("_top")).select(
        user_key, F.transform("_top", lambda t: t["m"]).alias("matches"))
    none = F.array().cast(dict(top.dtypes)["matches"])
    return users.select(user_key).join(top, user_key, "left").select(user_key, F.coalesce("matches", none).alias("matches"))
