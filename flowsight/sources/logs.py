"""Line-oriented logs: JSON events and ``time | component | message`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CORRUPT

LINE_ORDER = ("log_file", "log_block", "log_line")
EVENT_SCHEMA = f"timestamp string, event_type string, details string, {CORRUPT} string"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with an order that follows each file: (file, split start, line within the split).

    A file is cut into splits that are read in order, so ``log_line`` rises within a split.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("log_block"),
        F.monotonically_increasing_id().alias("log_line"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def parse_events(lines: DataFrame) -> DataFrame:
    """JSON lines -> event fields; blank lines are no events, broken ones are kept with ``malformed`` set."""
    event = F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    others = [c for c in lines.columns if c != "value"]
    # inline() rather than struct access: later filters on the fields then do not parse the line again
    parsed = lines.where(F.trim("value") != "").select(*others, F.inline(F.array(event)))
    return parsed.select("timestamp", "event_type", "details", F.col(CORRUPT).isNotNull().alias("malformed"), *others)


def parse_pipeline_log(lines: DataFrame) -> DataFrame:
    """``time | component | message``; later bars belong to the message."""
    part = F.split("value", r" \| ", 3)
    others = [c for c in lines.columns if c != "value"]
    return lines.select(
        F.get(part, F.lit(0)).alias("logged_at"),
        F.get(part, F.lit(1)).alias("component"),
        F.get(part, F.lit(2)).alias("message"),
        *others,
    )


def read_event_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_events(read_lines(spark, path))


def read_pipeline_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pipeline_log(read_lines(spark, path))
