"""Flow records as JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import first_non_blank
from ..schema import (
    CANONICAL_MESSAGE_HEADER,
    CORRUPT,
    MESSAGE_ALIASES,
    STREAM_COLUMNS,
    TEXT_DEFAULTS,
    header_lookup,
    quoted,
)

TOPIC = "security-logs"
INTEGER_FIELDS = ("port", "status_code")


def _typed(name: str, text: Column) -> Column:
    if name in TEXT_DEFAULTS:
        return text
    number = text.try_cast("double")
    return number.try_cast("bigint") if name in INTEGER_FIELDS else number


def canonicalize_message(df: DataFrame) -> DataFrame:
    """Message fields of any flow table, each the first non-blank of its aliases in that row.

    A table whose header already holds the canonical names is read by those alone.
    """
    present = header_lookup(df.columns)
    canonical = set(CANONICAL_MESSAGE_HEADER) <= set(present)
    fields = []
    for name, aliases in MESSAGE_ALIASES.items():
        options = aliases[:1] if canonical else aliases
        values = [quoted(present[a]) for a in options if a in present]
        text = first_non_blank(*values, default=TEXT_DEFAULTS.get(name, "0"))
        fields.append(_typed(name, text).alias(name))
    return df.select(*fields)


def to_messages(df: DataFrame, topic: str = TOPIC) -> DataFrame:
    """(topic, value) rows for a Kafka sink; ``df`` holds canonical message fields."""
    fields = [
        (_typed(c, F.col(c).cast("string")) if c in INTEGER_FIELDS else F.col(c)).alias(c) for c in STREAM_COLUMNS
    ]
    value = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.lit(topic).alias("topic"), value.alias("value"))


def read_flow_messages(messages: DataFrame) -> DataFrame:
    """Decode ``value`` (bytes or text) of a batch or a stream into canonical flow fields.

    Fields are taken as text and cast afterwards, so 22, 22.0 and "22" all decode. A malformed message keeps its text in
    the corrupt-record column, which ``clean_stream`` leaves out and the quarantine takes.
    """
    wire = T.StructType([T.StructField(c, T.StringType()) for c in (*STREAM_COLUMNS, CORRUPT)])
    text = F.col("value").cast("string")
    decoded = messages.select(F.from_json(text, wire, {"columnNameOfCorruptRecord": CORRUPT}).alias("m"), text.alias("_text"))
    # an empty or null message parses to no record at all
    corrupt = F.when(F.col("m").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col(f"m.{CORRUPT}"))
    return decoded.select(*[_typed(c, F.col(f"m.{c}")).alias(c) for c in STREAM_COLUMNS], corrupt.alias(CORRUPT))


def kafka_messages(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    """The topic from its beginning, as a stream; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )


def send_messages(df: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Publish a table to the topic; needs the Kafka connector on the class path."""
    to_messages(df, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
