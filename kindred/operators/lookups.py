"""Keyed lookups for a batch of requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(
    requests: DataFrame, table: DataFrame, key: str, defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every request with the table's columns; unknown keys give null or the stated default."""
    out = requests.join(table, key, "left")
    for column, default in (defaults or {}).items():
        out = out.withColumn(column, F.coalesce(F.col(column), default))
    return out


def restrict(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``allowed``."""
    return df.join(allowed.select(key), key, "left_semi")
