"""Table, report, log and preview sinks. The table format is a parameter; Parquet is the default."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..schema import canonicalize, quoted, validate_schema

AUDIT_SCHEMA = "run_timestamp_utc string, dataset string, processed_output string, quarantine_output string, audit_status string"
UPLOAD_SCHEMA = (
    "uploaded_at string, original_name string, saved_path string, normalized_csv_path string, file_type string, "
    "file_size bigint, row_count bigint, column_count int, schema_json string, status string"
)


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()


def _csv(df: DataFrame) -> DataFrameWriter:
    """Headed CSV that keeps blanks around values."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return df.write.options(header=True, **keep)


def write_csv(df: DataFrame, path: str) -> None:
    _csv(df).csv(path)


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a feature or prediction table, schema included; stamps ``processed_at``."""
    stamped = df.withColumn("processed_at", F.current_timestamp())
    stamped.write.format(fmt).mode("overwrite").option("overwriteSchema", True).save(path)


def write_quarantine(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rejected rows; columns may differ between runs, readers merge the schemas."""
    stamped = df.withColumn("quarantined_at", F.current_timestamp())
    stamped.write.format(fmt).mode("append").option("mergeSchema", True).save(path)


def write_audit(
    spark: SparkSession, path: str, dataset: str, processed: str, quarantine: str, status: str = "success", fmt: str = "parquet"
) -> DataFrame:
    row = spark.createDataFrame([(utc_now(), dataset, processed, quarantine, status)], AUDIT_SCHEMA)
    row.write.format(fmt).mode("append").save(path)
    return row


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append event rows (timestamp, event_type, details) as JSON lines; a struct of details is nested."""
    event = F.to_json(F.struct("timestamp", "event_type", "details"))
    df.select(event.alias("value")).write.mode("append").text(path)


def append_event(spark: SparkSession, path: str, event_type: str, details: Mapping[str, Any]) -> None:
    """Append one event; numbers and truth values among its details keep their types, anything else is text."""
    typed = {k: v if isinstance(v, (bool, int, float, str)) or v is None else str(v) for k, v in details.items()}
    columns = [F.lit(v).alias(k) for k, v in typed.items()]
    row = spark.range(1).select(
        F.lit(utc_now()).alias("timestamp"), F.lit(event_type).alias("event_type"),
        (F.struct(*columns) if columns else F.create_map().cast("map<string,string>")).alias("details"),
    )
    append_events(row, path)


def append_log(spark: SparkSession, path: str, component: str, message: str) -> None:
    line = f"{utc_now()} | {component} | {message}"
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(path)


def write_actions_csv(df: DataFrame, folder: str) -> str:
    """Defence actions, stamped with the time of the run, under a folder named by it."""
    df = df.select(F.lit(utc_now()).alias("timestamp"), *[quoted(c) for c in df.columns if c != "timestamp"])
    path = f"{folder.rstrip('/')}/defense_actions_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    _csv(df).csv(path)
    return path


def write_normalized(df: DataFrame, path: str) -> dict[str, str]:
    """Accept an upload: check its columns and that it has rows, store it as headed CSV, return its schema."""
    schema = validate_schema(df)
    if df.isEmpty():
        raise ValueError("the dataset has no rows")
    _csv(df).mode("overwrite").csv(path)
    return schema


def write_canonical(df: DataFrame, path: str) -> None:
    """The canonical columns of any accepted upload as headed CSV."""
    validate_schema(df)
    _csv(canonicalize(df)).mode("overwrite").csv(path)


def write_uploaded(df: DataFrame, path: str, fmt: str = "parquet") -> tuple[int, list[str]]:
    """Store an upload as a table; the row count comes from the stored table's footers."""
    df.write.format(fmt).mode("overwrite").save(path)
    return df.sparkSession.read.format(fmt).load(path).count(), df.columns


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a fixed order (all columns when none is given)."""
    return df.orderBy(*[quoted(c) for c in (order or df.columns)]).limit(n)


def write_previews(tables: Mapping[str, tuple[DataFrame, int]], folder: str) -> None:
    """CSV previews such as processed 50, removed 5, quarantined 3."""
    for name, (df, n) in tables.items():
        _csv(preview(df, n).coalesce(1)).mode("overwrite").csv(f"{folder.rstrip('/')}/{name}")


def register_dataset(
    df: DataFrame,
    registry: str,
    original_name: str,
    saved_path: str,
    normalized_path: str,
    file_type: str,
    file_size: int,
    fmt: str = "parquet",
) -> DataFrame:
    """Append one metadata row about an uploaded dataset."""
    row = (
        utc_now(), original_name, saved_path, normalized_path, file_type, int(file_size),
        df.count(), len(df.columns), df.schema.json(), "processed",
    )
    entry = df.sparkSession.createDataFrame([row], UPLOAD_SCHEMA)
    entry.write.format(fmt).mode("append").save(registry)
    return entry
