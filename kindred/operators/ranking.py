"""Positions in one global order, for every row."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import settle

# ``monotonically_increasing_id`` numbers rows below this bit, partitions from it.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Every row with its place (from 1) in the order, which must decide between any two rows.

    Rows are cut by range and sorted within their partitions; a place is the row's number in its partition plus the
    rows of the partitions before it. What reaches the driver is one count per partition. The cut rows are settled, so a
    task that runs again sees the same cut.
    """
    cut = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _ROW_BITS)
    counts = sorted(map(tuple, cut.groupBy(part.alias("_part")).count().collect()))
    before = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame(pa.table({
        "_part": pa.array([p for p, _ in counts], pa.int64()), "_before": pa.array(list(before)[:-1], pa.int64())}))
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return cut.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + row + 1).drop("_part", "_before", "_at")
