"""Typed Parquet scans and the append-only ledger sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.schemas import TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project onto a declared schema: its columns in order, cast; absent columns are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[name].fields])


def append_dated(df: DataFrame, path: str, ts: str, with_id: str | None = None) -> None:
    """Append rows in one folder per day of ``ts`` (partition column ``entry_date``).

    The rebalance splits a busy day and merges quiet ones by size, so the sink writes neither one
    giant file nor one small file per task and day. Ids are drawn after it, in the task that
    writes them. Trailing-window jobs then read the days they need
    (:func:`kindred.plans.matching.recent_rows`).
    """
    dated = df.withColumn("entry_date", F.to_date(ts)).hint("rebalance", F.col("entry_date"))
    if with_id:
        dated = dated.withColumn(with_id, F.uuid())
    dated.write.mode("append").partitionBy("entry_date").parquet(path)


def append_ledger(entries: DataFrame, path: str, as_of: Column) -> None:
    """Append entries with a generated id, and ``as_of`` where no time is given."""
    created = F.coalesce(F.col("created_at"), as_of) if "created_at" in entries.columns else as_of
    append_dated(entries.withColumn("created_at", created), path, "created_at", with_id="id")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and len(files.listStatus(where)) > 0


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows under ``path``; none if nothing has been written there yet."""
    if not written(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    return rows.select(StructType.fromDDL(schema).names)


def overwrite_partition(rows: DataFrame, path: str, column: str, value: int) -> None:
    """Write the rows as partition ``column=<value>``; what an earlier attempt wrote there gives way."""
    (rows.withColumn(column, F.lit(value).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path))


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table cut by the hash of ``key`` into ``buckets`` sorted files, and read it back as ``name``.

    Joins, aggregates and upserts on ``key`` then read the stored side where it lies; only what meets it is shuffled, if it
    is not stored the same way. One task writes each bucket.
    """
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """Name a table that another session has stored with :func:`save_bucketed`."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
