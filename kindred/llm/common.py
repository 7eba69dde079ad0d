"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (long, may be null) and ``text`` (null becomes empty); other columns are left out."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def share(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus`` (a null id counts as the empty string)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def row_key() -> Column:
    """A key of (doc_id, text): rows that repeat both share it and are treated alike."""
    return F.xxhash64("doc_id", "text").alias("row")


def signed(value: int) -> int:
    """A 64-bit pattern as Spark's signed long."""
    return value - (1 << 64) if value >= 1 << 63 else value


def sample(docs: DataFrame, labels: DataFrame, label: str, zeros: int, ones: int) -> tuple[DataFrame, float | None]:
    """Labelled texts (``doc_id``, ``text``, ``label``) and the share of label 1 among all labelled ids.

    At most ``zeros`` and ``ones`` ids of either label, in the order of a hash of the id. Null labels and ids are left
    out; of conflicting labels of an id the higher counts. Only the ids are broadcast; texts stay where they are read.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    base = known.agg(F.avg("label")).first()[0]
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
             for y, n in ((0, zeros), (1, ones))]
    return texts(docs).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id"), base


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _id_name() -> Column:
    """The id as a string that is never null, so that it can be a join key."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and, under the returned names, the key that ``row_key`` gives its texts and the id.

    The hash alone could meet another document's by chance in a very large table; with the id only rows of one id
    are told apart by it.
    """
    row, name = fresh(docs, "row"), fresh(docs, "row_id")
    return docs.withColumns({
        row: F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))),
        name: _id_name()}), [row, name]


def keys_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """``row`` and ``doc_id`` of ``rows`` under the names that ``with_row_key`` gave."""
    return rows.select(F.col("row").alias(names[0]), _id_name().alias(names[1]))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that few texts at a time become Python objects.

    Workers run task after task; what earlier ones left in reference cycles is collected first.
    """
    gc.collect()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
