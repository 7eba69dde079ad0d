"""Per-key top-k and running values that stay distributed when one key is very large."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import settle

# Above this rank Spark no longer limits window groups before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000

# Up to this rank the rows that all map tasks send for one key (rank x tasks) fit one task without a salted round.
PLAIN_PAGE = 100


def heavy_keys(df: DataFrame, keys: Sequence[str | Column], above: int, name: str) -> DataFrame | None:
    """Keys with more than ``above`` rows and their count ``_n``, settled; None if there are none.

    One narrow aggregate; at most one row per ``above`` rows of ``df`` is written.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = settle(counts.filter(F.col("_n") > above), name)
    return None if found.isEmpty() else found


def top_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rn",
    salt_on: Sequence[str] | None = None,
    salts: int = 64,
) -> DataFrame:
    """Rows ranked 1..k within ``keys``.

    ``rank <= k`` right above the window lets Spark keep k rows per key and map task before the
    shuffle, so a hot key sends k x (map tasks) rows to its final task. With a large k that is
    still a lot; ``salt_on`` adds a first round over ``salts`` slices of each key, and the final
    task then sees at most k x salts rows.
    """
    if salt_on:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= k).drop("_rn", "_salt"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running_by_key(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    hot_rows: int = 1_000_000,
    population: DataFrame | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running sums and running last-non-null values per key, ordered by (``ts``, ``tie``).

    A plain running window puts all rows of a key in one task. The keys (null is one too) with more
    than ``hot_rows`` rows are counted first; ``population`` (default ``df``) holds the keys of at
    least these rows and is only counted, so pass the plain table where computing ``df`` is costly.
    Without such keys the plain window is used. Otherwise their rows are cut by range into chunks of
    about ``hot_rows`` rows of consecutive (key, ``ts``, ``tie``): a single hour or timestamp is cut
    like any other stretch. The chunks are pre-aggregated, a window over the chunk totals (few rows
    per key) yields what each chunk starts from, and the row-level window runs per chunk. The cut
    rows are settled, so a retried task sees the same chunks.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys, names = list(keys), [*sums, *lasts]
    values = [f"_v_{name}" for name in names]
    df = df.withColumns({f"_v_{name}": value for name, value in {**sums, **lasts}.items()})

    hot = heavy_keys(df if population is None else population, keys, hot_rows, "hot-keys")
    if hot is None:
        return _running(df, keys, ts, tie, sums, lasts, descending).drop(*values)

    same = reduce(lambda a, b: a & b, (df[c].eqNullSafe(hot[c]) for c in keys))
    plain = _running(df.join(hot, same, "left_anti"), keys, ts, tie, sums, lasts, descending)
    chunks = 1 + int(hot.agg(F.sum("_n")).first()[0] // max(1, hot_rows))
    cut = settle(df.join(hot, same, "left_semi").repartitionByRange(chunks, *keys, ts, tie)
                 .withColumn("_chunk", F.spark_partition_id()), "chunks")
    def step(c: str) -> Column:
        return F.desc(c) if descending else F.asc(c)

    edge = F.min_by if descending else F.max_by
    per_chunk = cut.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{c}").alias(f"_t_{c}") for c in sums],
        *[edge(f"_v_{c}", F.when(F.col(f"_v_{c}").isNotNull(), F.struct(ts, tie))).alias(f"_t_{c}") for c in lasts],
    )
    before = Window.partitionBy(*keys).orderBy(step("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_chunk").alias("_k_chunk"),
        *[F.sum(f"_t_{c}").over(before).alias(f"_c_{c}") for c in sums],
        *[F.last(f"_t_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in lasts],
    )
    meets = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys),
                   F.col("_chunk") == F.col("_k_chunk"))
    # Named explicitly: the join's own partitioning may put all chunks of a key in one task.
    spread = cut.join(carry, meets, "left").repartition(*[F.col(c) for c in [*keys, "_chunk"]])
    out = _running(spread, [*keys, "_chunk"], ts, tie, sums, lasts, descending)
    for c in sums:
        out = out.withColumn(c, F.col(c) + F.coalesce(f"_c_{c}", F.lit(0)))
    for c in lasts:
        out = out.withColumn(c, F.coalesce(c, f"_c_{c}"))
    plain = plain.drop(*values)
    return plain.unionByName(out.select(plain.columns))


def _running(
    df: DataFrame, keys: list[str], ts: str, tie: str, sums: Mapping[str, Column], lasts: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    order = [F.desc(ts), F.desc(tie)] if descending else [F.asc(ts), F.asc(tie)]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({
        **{c: F.coalesce(F.sum(f"_v_{c}").over(so_far), F.lit(0)) for c in sums},
        **{c: F.last(f"_v_{c}", ignorenulls=True).over(so_far) for c in lasts},
    })


def page_per_key(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    limit: int,
    offset: int = 0,
    rank: str = "rn",
    **options,
) -> DataFrame:
    """Newest-first page (LIMIT/OFFSET) of every key, ranked ``offset + 1 .. offset + limit``.

    Rows with a null key are one key like any other, at every depth.
    """
    last = offset + limit
    if last <= GROUP_LIMIT:
        ranked = top_k_per_key(df, [key], [F.desc(ts), F.desc(tie)], last, rank, salt_on=[tie] if last > PLAIN_PAGE else None)
    else:
        # A deep page would send most of a hot key to one task; a running count does not.
        ranked = running_by_key(df, [key], ts, tie, sums={rank: F.lit(1)}, descending=True, **options)
        ranked = ranked.withColumn(rank, F.col(rank).cast("int"))
    return ranked.filter(F.col(rank).between(offset + 1, last))
