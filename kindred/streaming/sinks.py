"""Where streams write: Spark's file sink, or one partition per micro-batch; and how both are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.sources import tables

ALL_THERE_IS = {"availableNow": True}


def append(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partition_by: list[str] | None = None,
           ) -> StreamingQuery:
    """Start the stream into Parquet files under ``path``: Spark's own sink, each row once over any restart."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or ALL_THERE_IS)).start()


def overwrite_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one micro-batch as partition ``batch=<id>``; a replayed batch takes the place of its first run."""
    tables.overwrite_partition(rows, path, "batch", batch_id)


def per_batch(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
    mode: str = "append", trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream; each micro-batch becomes, transformed, one partition under ``path``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        overwrite_batch(transform(batch), path, batch_id)

    return (stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ALL_THERE_IS)).start())


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a stream has written (``schema`` includes ``batch`` where batches are partitions); no rows before its first batch."""
    return tables.read_or_empty(spark, path, schema)


def latest_by_batch(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Newest emitted values per key."""
    return parts.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def state(spark: SparkSession, checkpoint: str, name: str = "current", schema: str | None = None) -> DataFrame:
    """The rows that a stream's keyed state holds after its last batch: key and value columns side by side.

    Read by Spark's state source from the checkpoint, so a reader gets one row per key and folds nothing. Before the
    first batch there are none (``schema``).
    """
    if not tables.written(spark, f"{checkpoint}/state"):
        return spark.createDataFrame([], schema)
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    if "list_element" in rows.columns:
        return rows.select("key.*", "list_element.*")
    if "value" not in rows.columns:
        return rows.select("key.*", "user_map_key.*", "user_map_value.*")
    # With a lifetime the value lies beside the moment it ends.
    return rows.select("key.*", "value.value.*" if "ttlExpirationMs" in rows.schema["value"].dataType.names else "value.*")
