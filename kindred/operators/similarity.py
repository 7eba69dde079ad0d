"""Per-location vector search: the top k candidates of every user by cosine similarity.

Users are cut into blocks of one location (a location with many users gets many blocks), each
block is cogrouped with its location's candidates, and a task multiplies the two matrices and
keeps k rows per user. User x candidate pairs exist only inside that multiplication; what leaves
the task is one row per user. Candidates are bounded per location by the candidate cap, blocks by
``block_rows``, so no group grows with the data.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.skew import heavy_keys

# Task functions travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MATCH_FIELDS = ["community_id", "community_name", "category", "member_count", "recent_activity"]
# Scores that a task holds at once, and users they are of at most.
SCORES = 1 << 19
SUB_BLOCK = 4096

# No value of a location column equals this, so users without a location meet no candidate.
NO_LOCATION = "\u0000"


def vector_reason(vector: Column, dim: int) -> Column:
    """Why a vector cannot be compared in an index of ``dim`` values; null if it can."""
    return (F.when(vector.isNull(), "no vector")
            .when(F.size(vector) != dim, "wrong size")
            .when(~F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), "not finite"))


def vector_rejects(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The rows that a search of an index of ``dim`` values cannot use, with ``reason``."""
    return df.withColumn("reason", vector_reason(F.col(vector), dim)).filter(F.col("reason").isNotNull())


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of rows with a usable vector, those rows as a matrix); vectors of another size are null by now."""
    arr = column.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], type=column.type)
    ok = pc.is_valid(arr)
    rows = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    # Missing values become NaN.
    values = arr.filter(ok).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    finite = np.isfinite(values).all(axis=1)
    return (rows, values) if finite.all() else (rows[finite], values[finite])


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; rows of length 0 stay 0."""
    m = m.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    length[length == 0] = np.inf
    return m / length[:, None]


def _top_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) index pairs of the k best per row, best first; ties by column order. Pairs without a score are -inf."""
    n, m = scores.shape
    if m > k:
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        rows, cols = np.nonzero((scores >= kth[:, None]) & (scores > -np.inf))
    else:
        rows, cols = np.nonzero(scores > -np.inf)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(n))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep]


def _scorer(k: int, dim: int, keep: list[str], id_field: str, fields: list[str]) -> Callable:
    def score(users: pa.Table, candidates: pa.Table) -> pa.Table:
        n = users.num_rows
        candidates = candidates.sort_by(id_field)
        u_parts, c_parts, s_parts = [], [], []
        if n and candidates.num_rows:
            c_rows, c_mat = _matrix(candidates["vector"], dim)
            u_rows, u_mat = _matrix(users["vector"], dim)
            c_unit = _unit(c_mat).T
            step = min(SUB_BLOCK, max(2, SCORES // max(1, len(c_rows))))
            for at in range(0, len(u_rows), step):
                scores = _unit(u_mat[at:at + step]) @ c_unit
                np.round(scores, 12, out=scores)
                rows, cols = _top_k(scores, k)
                u_parts.append(u_rows[at + rows])
                c_parts.append(c_rows[cols])
                s_parts.append(scores[rows, cols])
        u_idx = np.concatenate(u_parts) if u_parts else np.empty(0, dtype=np.int64)
        c_idx = np.concatenate(c_parts) if c_parts else np.empty(0, dtype=np.int64)
        s_val = np.concatenate(s_parts) if s_parts else np.empty(0)
        picked = candidates.select(fields).take(pa.array(c_idx, type=pa.int64())).combine_chunks()
        columns = [_flat(picked[f]) for f in fields] + [pa.array(s_val, type=pa.float64())]
        structs = pa.StructArray.from_arrays(columns, names=[*fields, "match_score"])
        offsets = np.searchsorted(u_idx, np.arange(n + 1)).astype(np.int32)
        matches = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), structs)
        return users.select(keep).append_column("matches", matches)

    return score


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)


def top_k_by_cosine(
    users: DataFrame,
    candidates: DataFrame,
    index: DataFrame,
    dim: int,
    location: Sequence[str] = ("city", "timezone"),
    user_key: str = "user_id",
    keep: Sequence[str] | None = None,
    fields: Sequence[str] = tuple(MATCH_FIELDS),
    k: int = 20,
    population: DataFrame | None = None,
    block_rows: int = 8192,
) -> DataFrame:
    """One row per user: the ``keep`` columns and ``matches``, best first, ties by candidate id.

    ``users`` needs ``user_key``, the location columns and ``vector``; ``candidates`` the location
    columns and ``fields`` (first one the id); ``index`` that id and ``vector``, of ``dim`` values.
    Candidates without a usable vector of that size are left out and users without one get an empty
    array, whatever the vectors around them; :func:`vector_rejects` lists both with the reason.
    ``population`` (default ``users``) holds the locations of at least these users and only sizes the
    blocks; pass the plain table where computing ``users`` is costly, e.g. runs a model. Scores are
    rounded to 12 digits, which hides summation order.
    """
    keep = list(keep or [user_key])
    fields = list(fields)
    loc = [f"_{c}" for c in location]

    def key(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(NO_LOCATION))

    columns = dict.fromkeys([*keep, user_key])
    # Sizes are checked here; whether all values are finite is seen where the matrix is read.
    fits = F.size("vector") == dim
    usable = F.when(fits, F.col("vector"))
    left = users.select(*[key(c).alias(f"_{c}") for c in location], *columns, usable.alias("vector"))
    # Vectors join after the candidates are ranked, so ranking moves narrow rows only.
    right = candidates.dropna(subset=list(location)).select(
        *[F.col(c).cast("string").alias(f"_{c}") for c in location], *fields
    ).join(index.select(fields[0], "vector").filter(fits), fields[0])

    # Locations with more users than fit one block, and how many blocks each needs: at most one row
    # per ``block_rows`` users. It is settled, so that its size decides whether it is broadcast and the
    # vectors are not shuffled by location only to learn that no location is crowded.
    crowded = heavy_keys(users if population is None else population,
                         [key(c).alias(f"_{c}") for c in location], block_rows, "crowded")
    if crowded is None:
        left, right = left.withColumn("_block", F.lit(0)), right.withColumn("_block", F.lit(0))
    else:
        crowded = crowded.select(*loc, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"))
        blocks = F.coalesce(F.col("_blocks"), F.lit(1))
        left = (left.join(crowded, loc, "left")
                .withColumn("_block", F.pmod(F.xxhash64(user_key), blocks).cast("int"))
                .drop("_blocks"))
        # Candidates come here by id, so a crowded location's copies (one per block) are made by
        # many tasks.
        right = (right.join(crowded, loc, "left")
                 .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
                 .drop("_blocks"))

    field_type = {f.name: f.dataType.simpleString() for f in candidates.schema}
    struct = ",".join([f"{f}:{field_type[f]}" for f in fields] + ["match_score:double"])
    user_type = {f.name: f.dataType.simpleString() for f in users.schema}
    schema = ", ".join([f"`{c}` {user_type[c]}" for c in keep] + [f"matches array<struct<{struct}>>"])
    return (left.groupBy(*loc, "_block").cogroup(right.groupBy(*loc, "_block"))
            .applyInArrow(_scorer(k, dim, keep, fields[0], fields), schema))
