"""JSON messages in and out: profile requests, change events, keyed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.schemas import CHANNEL_PREFIX, PROFILE, USER_PAYLOAD


def parse_profiles(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(typed profile rows, rows whose JSON does not parse or lacks a required field)."""
    schema = T.StructType([*PROFILE.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = messages.select("*", once(F.from_json(
        F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})))
    good = F.col("_corrupt_record").isNull()
    for f in PROFILE.fields:
        good = good & F.col(f.name).isNotNull()
    others = [c for c in messages.columns if c != value]
    rows = parsed.filter(good).select(*others, *PROFILE.names)
    return rows, parsed.filter(~good).select(*messages.columns)


def parse_change_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelope -> type, user_id, first e-mail, names, open metadata. Unparsable rows vanish."""
    envelope = T.StructType([T.StructField("type", T.StringType()),
                             T.StructField("data", USER_PAYLOAD)])
    others = [c for c in messages.columns if c != value]
    parsed = messages.select(*others, once(F.from_json(F.col(value), envelope)))
    return (parsed.filter(F.col("type").isNotNull() & F.col("data").isNotNull())
            .select(*others, "type", F.col("data.id").alias("user_id"),
                    primary_email(F.col("data.email_addresses")).alias("email"),
                    "data.first_name", "data.last_name",
                    F.coalesce(F.to_json("data.public_metadata"), F.lit("{}")).alias("public_metadata")))


def once(struct: Column) -> Column:
    """The struct's fields as columns, computed once per row.

    A filter on parsed fields would otherwise be pushed below the parse and repeat it per field;
    filters do not pass a generator.
    """
    return F.inline(F.array(struct))


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON message per line, as ``value``; whole messages, parsed by the functions above."""
    return (spark.readStream if stream else spark.read).text(path)


def publish(keyed: DataFrame, format: str, **options: str) -> None:
    """Append (key, value) rows to a keyed sink, e.g. ``kafka`` where its connector is installed."""
    keyed.write.format(format).mode("append").options(**options).save()


def primary_email(addresses: Column) -> Column:
    return F.get(addresses, F.lit(0))["email_address"]


def channel(user_id: Column) -> Column:
    return F.concat(F.lit(CHANNEL_PREFIX), user_id.cast("string"))


def channel_user(name: Column) -> Column:
    return F.replace(name, F.lit(CHANNEL_PREFIX), F.lit(""))


def keyed_messages(results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(key, value) rows for a keyed sink; the value is the result as JSON."""
    body = F.struct(*(columns or results.columns))
    return results.select(channel(F.col("user_id")).alias("key"),
                          F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def parse_results(messages: DataFrame, schema: str) -> DataFrame:
    """Messages of the result channels: user recovered from the key, malformed JSON dropped.

    Each message is parsed once: what does not parse lands in the corrupt-record field.
    """
    corrupt = "_corrupt_record"
    typed = f"{schema}, {corrupt} string"
    found = messages.filter(F.startswith("key", F.lit(CHANNEL_PREFIX))).select(
        "*", channel_user(F.col("key")).alias("user_id"), once(F.struct(F.from_json(
            F.col("value"), typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("result"))))
    return found.filter(F.col("value").isNotNull() & F.col(f"result.{corrupt}").isNull()).withColumn(
        "result", F.col("result").dropFields(corrupt))
