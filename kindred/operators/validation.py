"""Row rules: each returns a reject reason (null = accepted), and ``split`` applies them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import strip
from kindred.schemas import PREFERENCE_CHOICES, PREFERENCE_FIELDS


def reject_if(bad: Column, reason: str) -> Column:
    return F.when(bad, F.lit(reason))


def bio_rule(bio: Column) -> Column:
    """Raw length 10..500 and at least 10 characters after stripping."""
    return F.coalesce(
        reject_if(bio.isNull(), "bio missing"),
        reject_if(F.length(bio) < 10, "bio too short"),
        reject_if(F.length(bio) > 500, "bio too long"),
        reject_if(F.length(strip(bio)) < 10, "bio blank"),
    )


def tag_count_rule(tags: Column) -> Column:
    return reject_if(tags.isNull() | ~F.size(tags).between(1, 20), "tag count")


def location_rule(location: Column) -> Column:
    """2..100 characters after stripping; null is allowed."""
    return reject_if(~F.length(strip(location)).between(2, 100), "location length")


def choice_rule(field: str, value: Column | None = None) -> Column:
    value = F.col(field) if value is None else value
    return reject_if(~value.isin(PREFERENCE_CHOICES[field]), f"{field} not a choice")


def range_rule(value: Column, low: float | None, high: float | None, reason: str) -> Column:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (value < low)
    if high is not None:
        outside = outside | (value > high)
    return reject_if(value.isNull() | outside, reason)


def self_only_rule(requester: Column, target: Column) -> Column:
    return reject_if(~requester.eqNullSafe(target), "forbidden")


def some_field_rule(fields: Sequence[str] = tuple(PREFERENCE_FIELDS)) -> Column:
    return reject_if(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNull(), "empty patch")


def patch_rules() -> list[Column]:
    return [location_rule(F.col("location")),
            *[choice_rule(f) for f in PREFERENCE_CHOICES],
            some_field_rule()]


def with_reason(df: DataFrame, rules: Sequence[Column], name: str = "reason") -> DataFrame:
    """First failing rule's reason, null for accepted rows."""
    return df.withColumn(name, F.coalesce(*rules) if len(rules) > 1 else rules[0])


def split(df: DataFrame, rules: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    checked = with_reason(df, rules)
    return (checked.filter(F.col("reason").isNull()).drop("reason"),
            checked.filter(F.col("reason").isNotNull()))


def known_active(requests: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """Requests with ``reason`` = 'not found' where the user is missing or inactive."""
    active = users.filter("is_active").select(key, F.lit(True).alias("_active"))
    return (requests.join(active, key, "left")
            .withColumn("reason", reject_if(F.col("_active").isNull(), "not found"))
            .drop("_active"))


def key_violations(
    df: DataFrame, table: str, key: Sequence[str], required: Sequence[str], check: str = "duplicate key",
) -> DataFrame:
    """Duplicate-key groups and null counts of one table, one row per check."""
    duplicates = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .agg(F.count(F.lit(1)).alias("violations"))
                  .select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
                          "violations"))
    if not required:
        return duplicates
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    unpivoted = nulls.unpivot([], list(required), "column_name", "violations").select(
        F.lit(table).alias("table_name"),
        F.concat(F.lit("null "), F.col("column_name")).alias("check_name"), "violations")
    return duplicates.unionByName(unpivoted)


def orphans(child: DataFrame, parent: DataFrame, fk: str, parent_key: str, name: str) -> DataFrame:
    """Child keys without a parent. The child is reduced to one row per key before the join."""
    per_key = child.groupBy(F.col(fk).alias("orphan_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    keys = parent.select(F.col(parent_key).alias("orphan_key"))
    return (per_key.join(keys, "orphan_key", "left_anti")
            .select(F.lit(name).alias("constraint_name"), "orphan_key", "n_rows"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def enum_violations(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows holding a value outside its column's domain, with the first such column."""
    rules = [reject_if(~F.col(c).isin(list(values)), f"{c} not a choice")
             for c, values in domains.items()]
    return with_reason(df, rules).filter("reason IS NOT NULL")
